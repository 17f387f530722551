"""Scalar functions and request normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptledger.functions import masking, text as tx
from promptledger.operators import requests as rq

from .registry import query
from .views import SECRET, table, texts, view

# RE2 spellings of the blank classes.
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BLANK = WS[:-1] + r"\x{1c}-\x{1f}]"


def pads(secret: str) -> tuple[str, str]:
    """Hex of the two HMAC pads for the SQL side."""
    block = secret.encode().ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


def sql_hash(expr: str) -> str:
    inner, outer = pads(SECRET)
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({expr}))))"


def sql_mask(k: str) -> str:
    parts = f"string_split({k}, '-')"
    return f"""CASE WHEN {k} IS NULL OR {k} = '' THEN '****'
  WHEN len({parts}) >= 3 AND len(list_filter({parts}, lambda x: x = '')) = 0 THEN {parts}[1] || '-****-' || {parts}[-1]
  WHEN length({k}) < 8 THEN '****'
  WHEN length({k}) >= 12 THEN left({k}, 4) || '****' || right({k}, 4)
  ELSE left({k}, 2) || '****' || right({k}, 2) END"""


TOKEN_RE2 = r"[\p{L}\p{N}_]{1,6}|[^\p{L}\p{N}_\s\p{Z}\x0B\x{85}\x1c-\x1f]"


def sql_tokens(expr: str) -> str:
    return f"cast(len(regexp_extract_all({expr}, '{TOKEN_RE2}')) AS integer)"


# ---------------------------------------------------------------- text
@query("fn1_token_count", f"SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents")
def fn1(spark, sf):
    return texts(spark, sf).select("doc_id", tx.count_tokens(F.col("text")).alias("tokens"))


@query("fn2_token_usage", f"""
SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN 0 ELSE n END)::BIGINT AS input_tokens,
       sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS output_tokens, sum(n)::BIGINT AS total_tokens
FROM (SELECT conv_id, role, {sql_tokens('text')} AS n FROM conversations) GROUP BY conv_id""")
def fn2(spark, sf):
    n, answer = tx.count_tokens(F.col("text")), F.col("role") == "assistant"
    used = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.sum(F.when(answer, 0).otherwise(n)).alias("input_tokens"),
        F.sum(F.when(answer, n).otherwise(0)).alias("output_tokens"))
    return used.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


@query("fn3_key_hash", f"SELECT c_custkey, {sql_hash('c_name')} AS key_hash FROM customer")
def fn3(spark, sf):
    padded = F.concat(F.lit(" \t"), F.col("c_name"), F.lit("\n"))
    return table(spark, sf, "customer").select("c_custkey", masking.hash_key(padded, SECRET).alias("key_hash"))


_RAW_KEY = """CASE c_custkey % 6 WHEN 0 THEN 'demo-key-' || c_custkey WHEN 1 THEN 'sk_live_' || c_name
 WHEN 2 THEN 'k' || (c_custkey % 1000) WHEN 3 THEN 'a--' || c_name WHEN 4 THEN NULL ELSE 'key' || (c_custkey * 7919) END"""


@query("fn4_key_mask", f"SELECT c_custkey, {sql_mask('k')} AS masked FROM (SELECT c_custkey, {_RAW_KEY} AS k FROM customer)")
def fn4(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.expr(_RAW_KEY).alias("k")).select(
        "c_custkey", masking.mask_key(F.col("k")).alias("masked"))


_IP = """CASE event_id % 9
 WHEN 0 THEN '203.0.' || (event_id % 256) || '.' || (user_id % 256)
 WHEN 1 THEN '2001:DB8:' || (event_id % 10000) || '::' || (user_id % 10000)
 WHEN 2 THEN '::ffff:10.0.0.' || (event_id % 256)
 WHEN 3 THEN 'fe80:0:' || (event_id % 10000) || ':1:2:3:4:5'
 WHEN 4 THEN '10.0.0.0' || (1 + event_id % 9)
 WHEN 5 THEN '2001::1::' || (event_id % 10)
 WHEN 6 THEN ' 192.168.' || (event_id % 256) || '.7 '
 WHEN 7 THEN '300.1.1.' || (event_id % 256)
 ELSE NULL END"""


@query("fn5_ip_mask", """
SELECT event_id, CASE event_id % 9
 WHEN 0 THEN '203.0.' || (event_id % 256) || '.***'
 WHEN 1 THEN '2001:0db8:' || lpad(cast(event_id % 10000 AS varchar), 4, '0') || ':****:****:****:****:****'
 WHEN 2 THEN '0000:0000:0000:****:****:****:****:****'
 WHEN 3 THEN 'fe80:0000:' || lpad(cast(event_id % 10000 AS varchar), 4, '0') || ':****:****:****:****:****'
 WHEN 6 THEN '192.168.' || (event_id % 256) || '.***'
 ELSE 'unknown' END AS masked_ip FROM events""")
def fn5(spark, sf):
    return table(spark, sf, "events").select("event_id", F.expr(_IP).alias("ip")).select(
        "event_id", masking.mask_ip(F.col("ip")).alias("masked_ip"))


@query("fn6_iso_timestamp", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(cast((epoch_us(ts) // 1000) % 1000 AS varchar), 3, '0') || 'Z' AS iso
FROM events""")
def fn6(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.to_iso(F.col("ts")).alias("iso"))


@query("fn7_transaction_id", """
SELECT event_id, 'txn_' || left(sha256(cast(event_id AS varchar) || '|' || event_type), 24) AS transaction_id FROM events""")
def fn7(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", tx.transaction_id(F.col("event_id"), F.col("event_type")).alias("transaction_id"))


@query("fn8_preview", f"""
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE left(t, 239) || '…' END AS preview
FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '{BLANK}+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents)""")
def fn8(spark, sf):
    return texts(spark, sf).select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query("fn9_percentile", """
SELECT user_id, round(list_sort(list(value))[cast(ceil(0.95 * count(*)) AS integer)], 2) AS p95
FROM events GROUP BY user_id""")
def fn9(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(tx.nearest_rank("value", 95).alias("p95"))


def _topic_sql(low: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains({low}, {w!r})' for w in words)} THEN '{name}'"
                     for name, words in tx.TOPIC_KEYWORDS)
    return f"CASE {cases} ELSE 'generic' END"


@query("fn10_topic_tag", f"SELECT doc_id, {_topic_sql('lower(text)')} AS topic FROM documents")
def fn10(spark, sf):
    return texts(spark, sf).select("doc_id", tx.topic_tag(F.col("text")).alias("topic"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


@query("fn11_topic_phrase", rf"""
SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN 'your request' ELSE array_to_string(w[1:4], ' ') END AS topic
FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(
        regexp_replace(text, '\[REDACTED_[A-Z_]+\]', ' ', 'g'), '[A-Za-z][A-Za-z0-9''-]*'), lambda x: lower(x)),
        lambda x: NOT list_contains([{_STOP}], x)) AS w FROM conversations)""")
def fn11(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.topic_phrase(F.col("text")).alias("topic"))


@query("fn12_hash_bucket", """
SELECT c_custkey, cast(list_reduce(list_transform(range(1, 65),
   lambda i: cast(strpos('0123456789abcdef', h[i]) - 1 AS bigint)), lambda a, d: (a * 16 + d) % 7) AS integer) AS bucket
FROM (SELECT c_custkey, sha256('gpt-4:' || c_name) AS h FROM customer)""")
def fn12(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", tx.hash_bucket(F.concat(F.lit("gpt-4:"), F.col("c_name")), 7).alias("bucket"))


@query("fn13_quota_level", """
SELECT id, CASE WHEN p >= 90 THEN 'crit' WHEN p >= 60 THEN 'warn' ELSE 'ok' END AS level, p AS percent
FROM (SELECT id, least(100.0, cost * 100.0 / 150)::DOUBLE AS p FROM quota_hits_v)""")
def fn13(spark, sf):
    used, limit = F.col("cost"), F.lit(150)
    return view(spark, sf, "quota_hits_v").select(
        "id", tx.quota_level(used, limit).alias("level"), tx.quota_percent(used, limit).alias("percent"))


# ---------------------------------------------------------------- requests
@query("prj1_strip", f"""
SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^{WS}+', ''), '{WS}+$', '') AS stripped FROM conversations""")
def prj1(spark, sf):
    padded = F.concat(F.lit("  \t"), F.col("text"), F.lit(" 　\n"))
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.strip(padded).alias("stripped"))


_BENT = """CASE WHEN request_id % 97 = 0 THEN 'gpt-99' WHEN request_id % 89 = 0 THEN NULL ELSE target_model END"""
_BENT_KEY = """CASE WHEN request_id % 83 = 0 THEN '  ' WHEN request_id % 79 = 0 THEN repeat('k', 257) ELSE api_key END"""


@query("prj2_validation", f"""
SELECT request_id, array_to_string(list_filter([
   CASE WHEN p IS NULL THEN 'prompt: field required' END,
   CASE WHEN regexp_full_match(p, '{BLANK}*') THEN 'prompt: must not be blank' END,
   CASE WHEN length(p) > 150 THEN 'prompt: exceeds 150 characters' END,
   CASE WHEN length(k) NOT BETWEEN 1 AND 256 THEN 'api_key: must have 1 to 256 characters' END,
   CASE WHEN m = 'gpt-99' THEN 'target_model: unsupported' END], lambda x: x IS NOT NULL), '; ') AS errors
FROM (SELECT request_id, trim(prompt) AS p, trim({_BENT_KEY}) AS k, {_BENT} AS m FROM requests_v)""")
def prj2(spark, sf):
    bent = view(spark, sf, "requests_v").withColumns({"target_model": F.expr(_BENT), "api_key": F.expr(_BENT_KEY)})
    good, bad = rq.validate(bent, max_chars=150)
    listed = F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["message"])), "; ")
    return bad.select("request_id", listed.alias("errors")).unionByName(
        good.select("request_id", F.lit("").alias("errors")))


_SPELLED = """CASE request_id % 8 WHEN 0 THEN ' GPT4 ' WHEN 1 THEN 'Gemini_Pro' WHEN 2 THEN 'GEMINI' WHEN 3 THEN 'LLAMA'
 WHEN 4 THEN 'gpt 4' WHEN 5 THEN 'My_Own Model' WHEN 6 THEN 'geminipro' ELSE target_model END"""
_MODEL_SQL = """CASE m WHEN 'gpt4' THEN 'gpt-4' WHEN 'gemini' THEN 'gemini-pro' WHEN 'geminipro' THEN 'gemini-pro' ELSE m END"""


@query("prj3_model_alias", f"""
SELECT request_id, {_MODEL_SQL} AS model
FROM (SELECT request_id, replace(replace(lower(trim({_SPELLED})), ' ', '-'), '_', '-') AS m FROM requests_v)""")
def prj3(spark, sf):
    return view(spark, sf, "requests_v").select("request_id", F.expr(_SPELLED).alias("m")).select(
        "request_id", rq.normalise_model(F.col("m")).alias("model"))


@query("prj4_model_name", """
SELECT request_id, CASE request_id % 5 WHEN 0 THEN 'GPT-4' WHEN 1 THEN 'Gemini Pro' WHEN 2 THEN 'Claude'
   WHEN 3 THEN 'Llama' ELSE 'GPT-4' END AS name FROM requests_v""")
def prj4(spark, sf):
    return view(spark, sf, "requests_v").select(
        "request_id", rq.model_name(rq.normalise_model(F.col("target_model"))).alias("name"))


@query("prj5_key_precedence", """
SELECT request_id, CASE WHEN api_key IS NULL OR request_id % 7 = 0 THEN 'header-' || user_id ELSE api_key END AS raw_key
FROM requests_v""")
def prj5(spark, sf):
    body = F.when(F.col("request_id") % 7 == 0, "").otherwise(F.col("api_key"))
    header = F.concat(F.lit("header-"), F.col("user_id").cast("string"))
    return view(spark, sf, "requests_v").select("request_id", rq.effective_key(body, header).alias("raw_key"))


@query("prj6_client_ip", """
SELECT request_id, CASE WHEN request_id % 3 = 0 THEN '198.51.100.' || (request_id % 256) ELSE client_ip END AS trusted,
       client_ip AS untrusted FROM requests_v""")
def prj6(spark, sf):
    hops = F.concat(F.lit(" 198.51.100."), (F.col("request_id") % 256).cast("string"), F.lit(" , 10.1.1.1"))
    xff = F.when(F.col("request_id") % 3 == 0, hops).when(F.col("request_id") % 3 == 1, "")
    return view(spark, sf, "requests_v").select(
        "request_id", rq.client_ip(xff, F.col("client_ip"), True).alias("trusted"),
        rq.client_ip(xff, F.col("client_ip"), False).alias("untrusted"))


@query("prj8_prompt_status", """
SELECT id, CASE WHEN pii_detected AND id % 2 = 0 THEN 'Contained PII — ' || redaction_count || ' value(s) redacted before forwarding'
   WHEN pii_detected THEN 'Contained PII — scrubbing disabled, forwarded unredacted (audit copy redacted)'
   ELSE 'Clean — no PII detected' END || CASE WHEN status = 'blocked' THEN '; blocked by injection defense' ELSE '' END AS said
FROM transactions_v""")
def prj8(spark, sf):
    said = rq.prompt_status(F.col("pii_detected"), F.col("id") % 2 == 0, F.col("redaction_count"), F.col("status") == "blocked")
    return view(spark, sf, "transactions_v").select("id", said.alias("said"))


@query("src1_request_log", """
SELECT request_id, ts, api_key, target_model, prompt, client_ip, enable_pii, enable_injection FROM requests_v""")
def src1(spark, sf):
    return view(spark, sf, "requests_v").drop("user_id")


