"""Sources and sinks, written and read back through the shared folder."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from promptledger.functions import injection as inj
from promptledger.functions.text import bucket_minutes, count_tokens
from promptledger.operators import requests as rq
from promptledger.operators.responses import attach_responses
from promptledger.plans import audit as au
from promptledger.plans.provider import Answer, attempts, response_log
from promptledger.session import use_checkpoint_dir
from promptledger.sources import readers, writers

from .decisions import CONFIG, _requests, key_dimension, sql_decided
from .registry import query
from .scalars import sql_tokens
from .views import table, view


def folder(spark, name: str) -> str:
    """A new place in the shared folder."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sinks
_STORED = "SELECT id, status, total_tokens::BIGINT AS total_tokens, CAST(timestamp AS DATE) AS event_date FROM transactions_v"


@query("snk1_transactions", _STORED)
def snk1(spark, sf):
    """Written in two parts, one of them twice as a stream batch."""
    path, rows = folder(spark, "snk1"), view(spark, sf, "transactions_v")
    writers.write_transactions(rows.where("id % 2 = 0"), path)
    for _ in range(2):
        writers.write_transactions(rows.where("id % 2 = 1"), path, "batch", batch_id=3)
    return spark.read.parquet(path).select("id", "status", F.col("total_tokens").cast("long").alias("total_tokens"), "event_date")


@query("snk2_threat_events", "SELECT id, threat_type, action, matched_rules FROM threats_v")
def snk2(spark, sf):
    path = folder(spark, "snk2")
    events = view(spark, sf, "threats_v").withColumn("matched_rules", F.split("matched_rules", ","))
    writers.write_threats(events, path)
    return spark.read.parquet(path).select("id", "threat_type", "action", "matched_rules")


@query("snk5_reset_tables", "SELECT request_id AS id, status FROM decided WHERE request_id % 2 = 1", *sql_decided(), recursive=True)
def snk5(spark, sf):
    """A store filled once, then emptied by a run over other requests; appending that run again changes nothing."""
    path, keys = folder(spark, "snk5"), key_dimension(spark, sf)
    done = au.audit(_requests(spark, sf), keys, CONFIG, view(spark, sf, "responses_v"), settle=True)
    done = writers.materialised(done)  # three runs write it
    odd = replace(done, decided=done.decided.where("request_id % 2 = 1"))
    writers.write_audit(done, path)
    writers.write_audit(odd, path, mode="overwrite")
    writers.write_audit(odd, path)
    return spark.read.parquet(f"{path}/transactions").select("id", "status")


# ---------------------------------------------------------------- sources
@query("src2_malformed_records", """
SELECT event_id AS request_id, CASE WHEN event_id % 10 = 3 THEN 'body: malformed record' ELSE '' END AS errors, event_id % 10 <> 3 AS valid
FROM events""")
def src2(spark, sf):
    """A JSON log in which a tenth of the lines are cut off."""
    path = folder(spark, "src2")
    reqs = _requests(spark, sf).withColumns({"prompt": F.lit("Compare two plans."), "api_key": F.lit("k"), "target_model": F.lit("gpt-4")})
    line = F.to_json(F.struct(*reqs.columns))
    cut = F.when(F.col("request_id") % 10 == 3, F.concat(F.lit('{"request_id": '), F.col("request_id").cast("string"), F.lit(', "prompt": "never end'))).otherwise(line)
    reqs.select(cut.alias("value")).write.text(path)
    checked = rq.check(readers.read_requests(spark, path, "json"))
    broken = F.regexp_extract(readers.CORRUPT, r"[0-9]+", 0).cast("long")
    kinds = F.array_join(F.array_distinct(F.transform(F.filter("errors", lambda e: e["field"] == "body"), lambda e: F.concat(e["field"], F.lit(": "), e["message"]))), "")
    return checked.select(F.coalesce("request_id", broken).alias("request_id"), kinds.alias("errors"), (F.size("errors") == 0).alias("valid"))


#: How the fields of a record are written, by its id: the JSON put in place of a field, and what is said about it.
_TYPED = {
    0: ("enable_pii", '"true"', None), 1: ("enable_pii", '"maybe"', "enable_pii: must be true or false"), 2: ("enable_pii", "1.0", None),
    3: ("enable_injection", "2", "enable_injection: must be true or false"), 4: ("enable_pii", "null", "enable_pii: must be true or false"),
    5: ("enable_injection", "[true]", "enable_injection: must be true or false"), 6: ("enable_pii", '"OFF"', None),
    7: ("prompt", "7", "prompt: must be text"), 8: ("target_model", "null", "target_model: unsupported"), 9: ("api_key", '{"k": 12}', "api_key: must be text"),
    10: ("api_key", "null", None), 11: ("ts", '"noon"', "ts: must be a time"), 12: ("extra", '{"ts": 1, "prompt": [2]}', None), 13: ("request_id", '"%d"', None),
    14: ("prompt", "null", "prompt: must be text"),
}
_N_TYPED = 17


@query("src2_typed_fields", f"""
SELECT request_id, CASE request_id % {_N_TYPED} {" ".join(f"WHEN {k} THEN '{m}'" for k, (_, _, m) in _TYPED.items() if m)}
     WHEN 15 THEN 'body: malformed record' WHEN 16 THEN 'body: malformed record' ELSE '' END
   || CASE WHEN request_id % {_N_TYPED} IN (7, 14, 15, 16) THEN '' WHEN trim(prompt) = '' THEN CASE WHEN request_id % {_N_TYPED} IN (1, 3, 4, 5, 8, 9, 11) THEN '; ' ELSE '' END
        || 'prompt: must not be blank' WHEN length(trim(prompt)) > 8000 THEN CASE WHEN request_id % {_N_TYPED} IN (1, 3, 4, 5, 8, 9, 11) THEN '; ' ELSE '' END || 'prompt: exceeds 8000 characters' ELSE '' END AS errors,
   CASE WHEN request_id % {_N_TYPED} < 15 THEN CASE request_id % {_N_TYPED} WHEN 6 THEN false WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 4 THEN true ELSE enable_pii END END AS enable_pii,
   CASE WHEN request_id % {_N_TYPED} < 15 AND request_id % {_N_TYPED} NOT IN (7, 14) THEN length(trim(prompt)) END::INTEGER AS prompt_chars
FROM requests_v""")
def src2_typed(spark, sf):
    """A JSON log whose records have wrong types, texts for flags, nulls and further fields, are cut off or are no objects."""
    path = folder(spark, "typed")
    reqs = _requests(spark, sf)
    # The field comes last, in place of its column.
    line = F.lit(None).cast("string")
    for k, (field, written, _) in _TYPED.items():
        rest = F.to_json(F.struct(*[c for c in reqs.columns if c != field]))
        value = F.format_string(written, "request_id") if "%d" in written else F.lit(written)
        line = F.when(F.col("request_id") % _N_TYPED == k, F.concat(F.substring(rest, F.lit(1), F.length(rest) - 1), F.lit(f', "{field}": '), value, F.lit("}"))).otherwise(line)
    whole = F.to_json(F.struct(*reqs.columns))
    line = F.when(F.col("request_id") % _N_TYPED == 15, F.substring(whole, F.lit(1), F.length(whole) - 5)) \
        .when(F.col("request_id") % _N_TYPED == 16, F.format_string("[%d]", "request_id")).otherwise(line)
    reqs.select(line.alias("value")).write.text(path)
    checked = rq.check(readers.read_requests(spark, path, "json"))
    broken = F.regexp_extract(readers.CORRUPT, r"[0-9]+", 0).cast("long")
    said = F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["message"])), "; ")
    return checked.select(F.coalesce("request_id", broken).alias("request_id"), said.alias("errors"),
                          F.when(F.col(readers.CORRUPT).isNull(), F.col("enable_pii")).alias("enable_pii"), F.length("prompt").alias("prompt_chars"))


def _rule_file(spark, sf) -> str:
    """A rule file made of the customer segments: one good rule each, and entries that cannot be used."""
    path = folder(spark, "rules")
    names = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("s")).distinct()
    good = F.struct(F.concat(F.lit("seg_"), F.lower("s")).alias("name"), F.concat(F.lit(r"\b"), F.lower(F.left("s", F.lit(3)))).alias("pattern"),
                    F.lit("POLICY_BYPASS").alias("threat_type"), F.lit("LOW").alias("risk_level"), F.lit(0.25).alias("weight"))
    bad = F.struct(F.concat(F.lit("bad_"), F.lower("s")).alias("name"), F.lit("(").alias("pattern"), F.lit("POLICY_BYPASS").alias("threat_type"),
                   F.lit("LOW").alias("risk_level"), F.lit(0.25).alias("weight"))
    names.select(F.explode(F.array(good, bad)).alias("r")).select("r.*").coalesce(1).write.json(path)
    return path


def _segment_rules(spark, sf):
    return readers.load_rules(spark, _rule_file(spark, sf), multi_line=False)


@query("src4_rule_file", """
SELECT 'seg_' || lower(c_mktsegment) AS name, 'kept' AS outcome FROM (SELECT DISTINCT c_mktsegment FROM customer)
UNION ALL SELECT 'bad_' || lower(c_mktsegment), 'rejected' FROM (SELECT DISTINCT c_mktsegment FROM customer)""")
def src4(spark, sf):
    good, rejected = _segment_rules(spark, sf)
    kept = spark.createDataFrame([(r.name,) for r in good], "name string")
    return kept.select("name", F.lit("kept").alias("outcome")).unionByName(rejected.select("name", F.lit("rejected").alias("outcome")))


@query("ex4_rules_from_records", """
SELECT doc_id, seg.name AS rule FROM documents, (SELECT DISTINCT 'seg_' || lower(c_mktsegment) AS name, lower(left(c_mktsegment, 3)) AS p FROM customer) seg
WHERE regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])' || seg.p)""")
def ex4(spark, sf):
    """Rules read from a file, matched against all documents."""
    good, _ = _segment_rules(spark, sf)
    docs = readers.spread(table(spark, sf, "documents"))
    return inj.match_rules(docs, "doc_id", "text", tuple(sorted(good, key=lambda r: r.name)))


# ---------------------------------------------------------------- small functions and extension points
@query("fn14_bucket_size", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE 30 END::INTEGER AS minutes FROM orders""")
def fn14(spark, sf):
    windows = F.array(*[F.lit(bucket_minutes(w)) for w in (15, 60, 360, 1440)])
    return table(spark, sf, "orders").select("o_orderkey", F.get(windows, (F.col("o_orderkey") % 4).cast("int")).alias("minutes"))


@query("ex5_tokenizer_swap", """
SELECT request_id, greatest(1, len(regexp_extract_all(trim(prompt), '[^ ]+')))::INTEGER AS by_words FROM requests_v
WHERE trim(prompt) <> '' AND length(trim(prompt)) <= 8000""")
def ex5(spark, sf):
    """The same plan with another token count."""
    words = lambda c: F.greatest(F.lit(1), F.size(F.filter(F.split(c, " "), lambda w: w != "")))
    config = au.AuditConfig(CONFIG.secret, window_s=CONFIG.window_s, count=words)
    valid, _ = rq.validate(_requests(spark, sf))
    return au.prepare(valid, config).select("request_id", F.col("input_tokens").alias("by_words"))


@query("ex6_response_provider", f"""
SELECT request_id, 'echo: ' || reverse(left(trim(prompt), 40)) AS response, {sql_tokens("'echo: ' || reverse(left(trim(prompt), 40))")} AS output_tokens
FROM decided JOIN requests_v USING (request_id) WHERE status IN ('allowed', 'error')""", *sql_decided(), recursive=True)
def ex6(spark, sf):
    """Answers made by a caller's own batch function over the requests that go upstream."""
    def provider(sent):
        text = F.concat(F.lit("echo: "), F.reverse(F.left("text", F.lit(40))))
        return sent.select("request_id", text.alias("text"), F.lit(1.0).alias("latency_ms"), count_tokens(text).cast("int").alias("output_tokens"),
                           F.lit(None).cast("string").alias("error"))

    decided = au.decisions(_requests(spark, sf), key_dimension(spark, sf), CONFIG)
    prompts = rq.check(_requests(spark, sf)).select("request_id", F.col("prompt").alias("forwarded_text"))
    sent = au.forwarded(decided.join(prompts, "request_id"))
    return provider(sent).select("request_id", F.col("text").alias("response"), "output_tokens")


def _answers(model: str, fails_every: int):
    """A provider that turns some requests away and answers the others from their whole text."""
    def provider(requests):
        return [Answer(error="busy") if r.request_id % fails_every == 0 else
                Answer(f"{model}:{hashlib.md5(r.text.encode()).hexdigest()}", len(r.text)) for r in requests]

    return provider


@query("ex6_provider_fallback", """
SELECT request_id, CASE WHEN request_id % 12 = 0 THEN NULL WHEN request_id % 6 = 0 THEN 'm3' WHEN request_id % 3 = 0 THEN 'm2' ELSE 'm1' END || ':' || md5(trim(prompt)) AS response,
   CASE WHEN request_id % 12 <> 0 THEN length(trim(prompt)) END::INTEGER AS output_tokens, request_id % 12 = 0 AS upstream_failed,
   CASE WHEN request_id % 12 = 0 THEN 'm1: busy; m2: busy; m3: busy' END AS error
FROM decided JOIN requests_v USING (request_id) WHERE status IN ('allowed', 'error')""", *sql_decided(), recursive=True)
def ex6_fallback(spark, sf):
    """Three batch functions in order, over all requests that go upstream; their attempts end in the answers of the audit."""
    decided = au.decisions(_requests(spark, sf), key_dimension(spark, sf), CONFIG)
    prompts = rq.check(_requests(spark, sf)).select("request_id", F.col("prompt").alias("forwarded_text"))
    sent = au.forwarded(decided.join(prompts, "request_id"))
    log = response_log(attempts(sent, [("m1", _answers("m1", 3)), ("m2", _answers("m2", 6)), ("m3", _answers("m3", 12))]))
    answered = attach_responses(sent.select("request_id"), log).join(log.select("request_id", "error"), "request_id")
    return answered.select("request_id", "response", "output_tokens", "upstream_failed", "error")
