"""Keys, budgets, decisions and the audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from promptledger.functions.masking import hash_key, mask_key
from promptledger.functions.rules import Detector
from promptledger.operators import keys as ky, quota as qt, requests as rq, responses as rs
from promptledger.plans import audit as au

from .injections import sql_hits, sql_verdict
from .registry import query
from .scalars import sql_hash, sql_mask, sql_tokens
from .views import AS_OF, SECRET, WINDOW_S, table, view

W_US = WINDOW_S * 1_000_000
CONFIG = au.AuditConfig(SECRET, window_s=WINDOW_S)


def key_dimension(spark, sf) -> DataFrame:
    """keys_v as the key table, with hashes in place of raw keys."""
    raw = F.col("raw_key")
    return view(spark, sf, "keys_v").select(
        F.col("id").cast("int").alias("id"), hash_key(raw, SECRET).alias("key_hash"), "key_name",
        mask_key(raw).alias("masked_key"), "status", "rate_limit",
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_used_at"))


def _requests(spark, sf) -> DataFrame:
    return view(spark, sf, "requests_v").drop("user_id")


KEY_DIM = f"key_dim AS (SELECT id::INTEGER AS id, {sql_hash('raw_key')} AS key_hash, key_name, {sql_mask('raw_key')} AS masked_key, status, rate_limit FROM keys_v)"


# ---------------------------------------------------------------- keys
@query("src3_key_source", "SELECT * FROM key_dim", KEY_DIM)
def src3(spark, sf):
    return key_dimension(spark, sf).drop("created_at", "last_used_at")


@query("jn1_authentication", f"""
SELECT request_id, CASE WHEN api_key IS NULL THEN '-' ELSE {sql_hash('api_key')} END AS key_hash,
   {sql_mask('api_key')} AS masked_key, key_name, k.rate_limit AS key_limit,
   CASE WHEN api_key IS NULL THEN 'missing' WHEN k.status IS NULL THEN 'invalid' WHEN k.status <> 'active' THEN 'revoked' END AS auth_reason
FROM requests_v LEFT JOIN keys_v k ON k.raw_key = api_key""")
def jn1(spark, sf):
    done = ky.authenticate(_requests(spark, sf), key_dimension(spark, sf), SECRET, raw="api_key")
    return done.select("request_id", "key_hash", "masked_key", "key_name", "key_limit", "auth_reason")


@query("snk3_new_keys", "SELECT id, key_hash, coalesce(rate_limit, 100)::INTEGER AS rate_limit FROM key_dim WHERE id % 3 <> 0", KEY_DIM)
def snk3(spark, sf):
    dim = key_dimension(spark, sf)
    return ky.new_keys(dim.filter("id % 3 = 0"), dim).select("id", "key_hash", "rate_limit")


@query("jn7_upsert_keys", "SELECT id, CASE WHEN id % 3 = 0 THEN rate_limit ELSE coalesce(rate_limit, 100) END::INTEGER AS rate_limit FROM key_dim", KEY_DIM)
def jn7(spark, sf):
    dim = key_dimension(spark, sf)
    return ky.upsert_keys(dim.filter("id % 3 = 0"), dim).select("id", "rate_limit")


@query("snk4_touch_keys", """
SELECT k.id::INTEGER AS id, CASE WHEN k.status = 'active' THEN max(r.ts) END AS last_used_at
FROM keys_v k LEFT JOIN requests_v r ON r.api_key = k.raw_key GROUP BY k.id, k.status""")
def snk4(spark, sf):
    dim = key_dimension(spark, sf)
    valid = ky.authenticate(_requests(spark, sf), dim, SECRET, raw="api_key").filter(F.col("auth_reason").isNull())
    return ky.touch_keys(dim, valid).select("id", "last_used_at")


@query("tk5_key_listing", """
SELECT key_name, masked_key, status, rate_limit, '2024-01-01T00:00:00.000Z' AS created_at, CAST(NULL AS VARCHAR) AS last_used_at FROM key_dim""", KEY_DIM)
def tk5(spark, sf):
    return ky.list_keys(key_dimension(spark, sf))


# ---------------------------------------------------------------- budgets
def sql_fold(hits: str, w_us: int = W_US) -> list[str]:
    """CTEs of the admission recurrence over `hits` (k, id, us, cost, lim): one row per hit in `fold`."""
    live = f"list_filter(f.live, lambda e: e.us > h.us - {w_us})"
    used = f"coalesce(list_sum(list_transform({live}, lambda e: e.cost)), 0)"
    entry = "{'us': h.us, 'cost': h.cost::BIGINT}"
    return [
        f"numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY us, id) AS rn FROM ({hits}))",
        f"""fold AS (
  SELECT h.k, h.rn, h.id, h.us, h.cost, h.lim, CASE WHEN h.cost <= h.lim THEN [{entry}] ELSE [] END AS live,
     h.cost <= h.lim AS allowed, CASE WHEN h.cost <= h.lim THEN h.cost::BIGINT ELSE 0::BIGINT END AS used
  FROM numbered h WHERE h.rn = 1
  UNION ALL
  SELECT h.k, h.rn, h.id, h.us, h.cost, h.lim, CASE WHEN {used} + h.cost <= h.lim THEN list_append({live}, {entry}) ELSE {live} END,
     {used} + h.cost <= h.lim, ({used} + CASE WHEN {used} + h.cost <= h.lim THEN h.cost ELSE 0 END)::BIGINT
  FROM fold f JOIN numbered h ON h.k = f.k AND h.rn = f.rn + 1)""",
    ]


_HITS = "SELECT k, id, epoch_us(ts) AS us, cost, 100 AS lim FROM quota_hits_v"
_LIMITED = """SELECT k, id, epoch_us(ts) AS us, greatest(0, cost - 2)::INTEGER AS cost,
   coalesce(nullif(CASE WHEN k % 4 = 0 THEN 0 WHEN k % 4 = 1 THEN 300 END, 0), 100) AS lim FROM quota_hits_v"""


def _admissions(spark, sf):
    return qt.admissions(view(spark, sf, "quota_hits_v"), "k", "ts", "id", "cost", window_s=WINDOW_S)


@query("w1_admission", "SELECT k, id, allowed, used FROM fold", *sql_fold(_HITS), recursive=True)
def w1(spark, sf):
    return _admissions(spark, sf).select("k", "id", "quota.allowed", "quota.used")


@query("w1_busy_key", "SELECT k, id, allowed, used FROM fold",
       *sql_fold("SELECT CASE WHEN id % 3 = 0 THEN -1 ELSE k END AS k, id, epoch_us(ts) AS us, cost, 100 AS lim FROM quota_hits_v", 3_600_000_000),
       recursive=True)
def w1_busy(spark, sf):
    """A third of all rows under one key, cut into many runs."""
    hits = view(spark, sf, "quota_hits_v").withColumn("k", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("k")))
    done = qt.admissions(hits, "k", "ts", "id", "cost", window_s=3600, partitions=12)
    return done.select("k", "id", "quota.allowed", "quota.used")


@query("w1_saturated_key", "SELECT k, id, allowed, used FROM fold",
       *sql_fold("SELECT CASE WHEN id % 2 = 0 THEN -1 ELSE k END AS k, id, epoch_us(ts) AS us, cost, 40 AS lim FROM quota_hits_v", 1_800_000_000),
       recursive=True)
def w1_saturated(spark, sf):
    """Half of all rows under one key that always asks for more than its limit."""
    hits = view(spark, sf, "quota_hits_v").withColumns({
        "k": F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("k")), "lim": F.lit(40)})
    done = qt.admissions(hits, "k", "ts", "id", "cost", "lim", window_s=1800, partitions=12)
    return done.select("k", "id", "quota.allowed", "quota.used")


@query("w2_limit_and_cost", "SELECT k, id, allowed, used, lim AS token_limit, cost::BIGINT AS charged FROM fold", *sql_fold(_LIMITED), recursive=True)
def w2(spark, sf):
    hits = view(spark, sf, "quota_hits_v").withColumns({
        "cost": F.col("cost") - 2, "lim": F.when(F.col("k") % 4 == 0, 0).when(F.col("k") % 4 == 1, 300)})
    done = qt.admissions(hits, "k", "ts", "id", "cost", "lim", window_s=WINDOW_S)
    return done.select("k", "id", "quota.allowed", "quota.used", F.col("quota.limit").alias("token_limit"), F.col("cost").alias("charged"))


@query("w3_quota_state", f"""
SELECT id, lim AS token_limit, used, greatest(0, lim - used)::BIGINT AS remaining, len(live)::INTEGER AS request_count, {WINDOW_S} AS window_seconds,
   CASE WHEN len(live) = 0 THEN 0.0::DOUBLE ELSE (live[1].us + {W_US} - us) / 1000000.0::DOUBLE END AS reset_in_seconds FROM fold""",
       *sql_fold(_HITS), recursive=True)
def w3(spark, sf):
    q = "quota."
    return _admissions(spark, sf).select("id", F.col(q + "limit").alias("token_limit"), q + "used", q + "remaining",
                                         q + "request_count", q + "window_seconds", q + "reset_in_seconds")


@query("w4_retry_after", f"""
SELECT id, greatest(1, CASE WHEN cost > lim THEN {WINDOW_S} ELSE (SELECT ceil((min(live[i].us) + {W_US} - us) / 1000000.0)::INTEGER
   FROM range(1, len(live) + 1) r(i) WHERE list_sum(list_transform(live[1:i], lambda e: e.cost)) >= used + cost - lim) END)::INTEGER AS retry_after
FROM fold WHERE NOT allowed""", *sql_fold(_HITS), recursive=True)
def w4(spark, sf):
    done = _admissions(spark, sf).filter("NOT quota.allowed")
    return done.select("id", qt.retry_after(F.col("quota")).alias("retry_after"))


_STATE = """
SELECT u.k, 100 AS "limit", coalesce(sum(cost), 0)::BIGINT AS used, greatest(0, 100 - coalesce(sum(cost), 0))::BIGINT AS remaining,
   count(id)::INTEGER AS request_count, {w} AS window_seconds,
   coalesce((min(us) + {wus} - epoch_us(timestamp '{now}')) / 1000000.0::DOUBLE, 0.0) AS reset_in_seconds
FROM (SELECT DISTINCT k FROM quota_hits_v) u LEFT JOIN (SELECT * FROM fold WHERE allowed AND us <= epoch_us(timestamp '{now}')
   AND us > epoch_us(timestamp '{now}') - {wus} AND {extra}) a ON a.k = u.k GROUP BY u.k"""


def _state(spark, sf, resets=None):
    owners = view(spark, sf, "quota_hits_v").select("k").distinct().withColumn("rate_limit", F.lit(None).cast("int"))
    admitted = qt.admitted_entries(_admissions(spark, sf))
    return qt.quota_state(admitted, owners, AS_OF, key="k", window_s=WINDOW_S, resets=resets)


@query("w5_quota_peek", _STATE.format(w=WINDOW_S, wus=W_US, now=AS_OF, extra="true"), *sql_fold(_HITS), recursive=True)
def w5(spark, sf):
    return _state(spark, sf)


@query("w6_quota_reset", _STATE.format(w=WINDOW_S, wus=W_US, now=AS_OF, extra="""(k % 3 <> 0 OR us > epoch_us(timestamp '2024-01-30 06:00:00'))
   AND us > epoch_us(timestamp '2024-01-29 18:00:00')"""), *sql_fold(_HITS), recursive=True)
def w6(spark, sf):
    some = view(spark, sf, "quota_hits_v").filter("k % 3 = 0").select("k").distinct()
    resets = some.withColumn("reset_at", F.lit("2024-01-30 06:00:00").cast("timestamp_ntz"))
    whole = spark.range(1).select(F.lit(None).cast("bigint").alias("k"), F.lit("2024-01-29 18:00:00").cast("timestamp_ntz").alias("reset_at"))
    return _state(spark, sf, resets.unionByName(whole))


@query("w7_stage_durations", """
SELECT transaction_id, seq, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY transaction_id ORDER BY seq))) / 1000.0, 3)::DOUBLE AS duration_ms
FROM stage_log_v""")
def w7(spark, sf):
    return rs.stage_durations(view(spark, sf, "stage_log_v")).select("transaction_id", "seq", "duration_ms")


@query("w9_demand", f"""
SELECT k, id, (sum(cost) OVER (PARTITION BY k ORDER BY epoch_us(ts) RANGE BETWEEN {W_US - 1} PRECEDING AND CURRENT ROW))::BIGINT AS demand FROM quota_hits_v""")
def w9(spark, sf):
    return qt.demand(view(spark, sf, "quota_hits_v"), "k", "ts", "id", "cost", WINDOW_S).select("k", "id", "demand")


@query("prj9_quota_info", f"""
SELECT id, lim || '/' || used || '/' || greatest(0, lim - used) || '/' || len(live) || '/' || {WINDOW_S} AS info FROM fold""", *sql_fold(_HITS), recursive=True)
def prj9(spark, sf):
    info = qt.quota_info(F.col("quota"))
    parts = [info[f].cast("string") for f in ("limit", "used", "remaining", "request_count", "window_seconds")]
    return _admissions(spark, sf).select("id", F.concat_ws("/", *parts).alias("info"))


# ---------------------------------------------------------------- decisions
def sql_decided(threshold: int = 2, limit: int = 100) -> list[str]:
    """CTEs ending in `decided`: status and threat per valid request, from the definitions alone."""
    hits = f"""SELECT user_id AS k, request_id AS id, epoch_us(ts) AS us, tokens AS cost, coalesce(lim, {limit}) AS lim FROM asked WHERE auth IS NULL"""
    return [
        f"""asked AS (SELECT r.*, {sql_tokens('trim(prompt)')} AS tokens, k.rate_limit AS lim,
   CASE WHEN api_key IS NULL THEN 'missing' WHEN k.status IS NULL THEN 'invalid' WHEN k.status <> 'active' THEN 'revoked' END AS auth
 FROM requests_v r LEFT JOIN keys_v k ON k.raw_key = r.api_key WHERE trim(prompt) <> '' AND length(trim(prompt)) <= 8000)""",
        *sql_fold(hits), *sql_hits("asked", "request_id", "prompt"), *sql_verdict("request_id", threshold),
        """decided AS (SELECT a.request_id, a.user_id, a.ts, a.tokens, auth, f.allowed, f.used, f.lim AS quota_limit, v.threat_type AS found,
   v.risk_level AS risk, v.matched_rules AS rules,
   CASE WHEN auth IN ('missing', 'invalid') THEN 'unauthorized' WHEN auth = 'revoked' THEN 'forbidden' WHEN NOT f.allowed THEN 'rate_limited'
        WHEN enable_injection AND coalesce(v.blocked, false) THEN 'blocked' WHEN a.request_id % 17 = 4 THEN 'error' ELSE 'allowed' END AS status
 FROM asked a LEFT JOIN fold f ON f.id = a.request_id LEFT JOIN verdict v ON v.request_id = a.request_id)""",
    ]


def _decided(spark, sf, config=CONFIG):
    return au.decisions(_requests(spark, sf), key_dimension(spark, sf), config, view(spark, sf, "responses_v"))


@query("pl1_decision", """
SELECT request_id, status, CASE status WHEN 'unauthorized' THEN 401 WHEN 'forbidden' THEN 403 WHEN 'rate_limited' THEN 429 WHEN 'blocked' THEN 403
   WHEN 'error' THEN 500 ELSE 200 END AS http_status FROM decided""", *sql_decided(), recursive=True)
def pl1(spark, sf):
    return _decided(spark, sf).select("request_id", "status", "http_status")


@query("pl2_budget_ordering", """
SELECT user_id, sum(CASE WHEN allowed THEN tokens ELSE 0 END)::BIGINT AS charged, count(*) FILTER (status = 'blocked') AS blocked,
   count(*) FILTER (allowed AND status IN ('unauthorized', 'forbidden')) AS charged_without_key FROM decided GROUP BY user_id""",
       *sql_decided(), recursive=True)
def pl2(spark, sf):
    owner = view(spark, sf, "requests_v").select("request_id", "user_id")
    done = _decided(spark, sf).join(owner, "request_id")
    return done.groupBy("user_id").agg(
        F.sum(F.when(F.col("quota.allowed"), F.col("input_tokens")).otherwise(0)).alias("charged"),
        F.count_if(F.col("status") == "blocked").alias("blocked"),
        F.count_if(F.col("quota.allowed") & F.col("status").isin("unauthorized", "forbidden")).alias("charged_without_key"))


@query("pl3_threat_events", """
SELECT request_id AS id, threat_type, risk_level, action, matched_rules FROM (SELECT request_id,
   CASE status WHEN 'unauthorized' THEN 'UNAUTHORIZED_ACCESS' WHEN 'forbidden' THEN 'REVOKED_KEY_USAGE' WHEN 'rate_limited' THEN 'RATE_LIMIT_EXCEEDED' ELSE found END AS threat_type,
   CASE WHEN status IN ('unauthorized', 'forbidden') THEN 'MEDIUM' WHEN status = 'rate_limited' THEN 'LOW' ELSE risk END AS risk_level,
   CASE WHEN status IN ('unauthorized', 'forbidden') THEN 'REJECTED' WHEN status = 'rate_limited' THEN 'THROTTLED' WHEN status = 'blocked' THEN 'BLOCKED' ELSE 'MONITORED' END AS action,
   CASE WHEN status IN ('unauthorized', 'forbidden') THEN auth WHEN status = 'rate_limited' THEN used || '+' || tokens || '>' || quota_limit ELSE rules END AS matched_rules
   FROM decided) WHERE threat_type IS NOT NULL""", *sql_decided(), recursive=True)
def pl3(spark, sf):
    events = au.derive_threats(_decided(spark, sf))
    return events.select("id", "threat_type", "risk_level", "action", F.array_join("matched_rules", ",").alias("matched_rules"))


def _audit(spark, sf, **options):
    return au.audit(_requests(spark, sf), key_dimension(spark, sf), CONFIG, view(spark, sf, "responses_v"), **options)


@query("pl4_audit_rows")
def pl4(spark, sf):
    return _audit(spark, sf).transactions.withColumn("pii_types", F.array_join("pii_types", ","))


@query("pl5_trace")
def pl5(spark, sf):
    traced = au.trace(_audit(spark, sf).decided)
    return traced.select("request_id", F.posexplode("pipeline").alias("step", "s")).select("request_id", "step", "s.*")


_EARLY = "('unauthorized', 'forbidden', 'rate_limited')"
_MODEL = "CASE target_model WHEN 'GPT-4' THEN 'gpt-4' WHEN 'gpt4' THEN 'gpt-4' WHEN 'Gemini Pro' THEN 'gemini-pro' WHEN 'Llama' THEN 'llama' ELSE target_model END"


@query("pl4_row_outcomes", f"""
SELECT request_id AS id, d.ts AS timestamp, {_MODEL} AS target_model, tokens::INTEGER AS input_tokens,
   CASE WHEN status = 'allowed' THEN output_tokens ELSE 0 END::INTEGER AS output_tokens, (tokens + CASE WHEN status = 'allowed' THEN output_tokens ELSE 0 END)::INTEGER AS total_tokens,
   CASE WHEN status = 'allowed' THEN latency_ms ELSE 0.0 END::DOUBLE AS llm_latency_ms, status,
   CASE status WHEN 'unauthorized' THEN 401 WHEN 'forbidden' THEN 403 WHEN 'rate_limited' THEN 429 WHEN 'blocked' THEN 403 WHEN 'error' THEN 500 ELSE 200 END AS http_status,
   status NOT IN {_EARLY} AND found IS NOT NULL AS injection_detected, CASE WHEN status NOT IN {_EARLY} THEN found END AS threat_type,
   CASE WHEN status NOT IN {_EARLY} THEN risk END AS risk_level, {sql_mask('api_key')} AS masked_api_key,
   regexp_replace(client_ip, '[.][0-9]+$', '.***') AS masked_ip
FROM decided d JOIN (SELECT request_id, api_key, target_model, client_ip FROM requests_v) r USING (request_id) JOIN responses_v USING (request_id)""",
       *sql_decided(), recursive=True)
def pl4_outcomes(spark, sf):
    """The audit rows, all but what the detectors of personal data say."""
    return _audit(spark, sf).transactions.select(
        "id", "timestamp", "target_model", "input_tokens", "output_tokens", "total_tokens", "llm_latency_ms", "status", "http_status",
        "injection_detected", "threat_type", "risk_level", "masked_api_key", "masked_ip")


_STEPS = f"""
SELECT d.*, r.enable_injection AS defended, {_MODEL} AS model, length(trim(r.prompt)) AS chars, {sql_mask('r.api_key')} AS mask, key_name, latency_ms,
   d.found || ' (' || risk || ')' AS label FROM decided d JOIN requests_v r USING (request_id) JOIN responses_v USING (request_id) LEFT JOIN keys_v k ON k.raw_key = r.api_key"""


@query("pl5_trace_stages", f"""
SELECT request_id, 0 AS step, 'validation' AS stage, 'passed' AS status, chars || ' chars, model=' || model AS detail FROM steps
UNION ALL SELECT request_id, 1, 'authentication', 'passed', 'key ' || mask || ' (' || coalesce(key_name, '') || ')' FROM steps WHERE status NOT IN ('unauthorized', 'forbidden')
UNION ALL SELECT request_id, 2, 'rate_limit', 'passed', used || '/' || quota_limit || ' tokens used in window' FROM steps WHERE status NOT IN {_EARLY}
UNION ALL SELECT request_id, 5, 'injection_detection', CASE WHEN found IS NULL THEN 'passed' WHEN status = 'blocked' THEN 'failed' ELSE 'flagged' END,
   CASE WHEN found IS NULL THEN 'no injection patterns matched' WHEN status = 'blocked' THEN label || ' via ' || replace(rules, ',', ', ')
        WHEN NOT defended THEN 'defense disabled — monitor only: ' || label ELSE label || ' below block threshold' END FROM steps WHERE status NOT IN {_EARLY}
UNION ALL SELECT request_id, 6, 'policy_decision', CASE WHEN status = 'blocked' THEN 'failed' ELSE 'passed' END,
   CASE WHEN status = 'blocked' THEN 'BLOCK — request never forwarded to the LLM' ELSE 'ALLOW' END FROM steps WHERE status NOT IN {_EARLY}
UNION ALL SELECT request_id, 7, 'llm_forwarding', CASE WHEN status = 'blocked' THEN 'skipped' ELSE 'passed' END,
   CASE WHEN status = 'blocked' THEN 'blocked by policy' ELSE CASE model WHEN 'gpt-4' THEN 'GPT-4' WHEN 'gemini-pro' THEN 'Gemini Pro' WHEN 'claude' THEN 'Claude' ELSE 'Llama' END
     || ' responded in ' || floor(latency_ms + 0.5)::BIGINT || ' ms' END FROM steps WHERE status IN ('allowed', 'blocked')
UNION ALL SELECT request_id, 8, 'telemetry', 'passed', 'audit record stored' FROM steps WHERE status IN ('allowed', 'blocked')""",
       *sql_decided(), f"steps AS ({_STEPS})", recursive=True)
def pl5_stages(spark, sf):
    """The trace, all but the two stages that look for personal data."""
    traced = au.trace(_audit(spark, sf).decided)
    steps = traced.select("request_id", F.posexplode("pipeline").alias("step", "s")).select("request_id", "step", "s.*")
    return steps.where(~F.col("stage").isin("pii_detection", "pii_redaction"))


@query("pl6_end_to_end", """
SELECT status, count(*) AS requests, sum(tokens)::BIGINT AS input_tokens, count(found) FILTER (status NOT IN ('unauthorized', 'forbidden', 'rate_limited')) AS injections,
   sum(CASE WHEN status = 'allowed' THEN output_tokens ELSE 0 END)::BIGINT AS output_tokens FROM decided JOIN responses_v USING (request_id) GROUP BY status""",
       *sql_decided(), recursive=True)
def pl6(spark, sf):
    return _audit(spark, sf).transactions.groupBy("status").agg(
        F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"),
        F.count_if("injection_detected").alias("injections"), F.sum("output_tokens").alias("output_tokens"))


@query("pl6_response")
def pl6_response(spark, sf):
    body = au.response_record(_audit(spark, sf, keep_text=True).decided)
    return body.select("transaction_id", F.to_json(F.struct("*")).alias("body"))




@query("pl7_replay", """
SELECT status AS old_status, CASE WHEN status IN ('blocked', 'allowed', 'error') THEN
     CASE WHEN e AND coalesce(risk = 'HIGH', false) THEN 'blocked' WHEN request_id % 17 = 4 THEN 'error' ELSE 'allowed' END ELSE status END AS new_status, count(*) AS n
FROM (SELECT d.*, enable_injection AS e FROM decided d JOIN requests_v r USING (request_id)) GROUP BY ALL""", *sql_decided(), recursive=True)
def pl7(spark, sf):
    strict = au.AuditConfig(SECRET, Detector(threshold="HIGH"), window_s=WINDOW_S)
    return au.replay(_requests(spark, sf), key_dimension(spark, sf), CONFIG, strict, view(spark, sf, "responses_v"))


@query("w5_key_status", f"""
SELECT {sql_mask('raw')} AS masked_key, CASE WHEN why IS NULL THEN 200 WHEN why = 'revoked' THEN 403 ELSE 401 END AS http_status, why AS auth_reason,
   CASE WHEN why IS NULL THEN coalesce(max(kl), 100) END AS token_limit, CASE WHEN why IS NULL THEN coalesce(sum(cost), 0)::BIGINT END AS used,
   CASE WHEN why IS NULL THEN count(id)::INTEGER END AS request_count
FROM (SELECT u.raw, u.k, y.rate_limit AS kl, CASE WHEN u.raw IS NULL THEN 'missing' WHEN y.status IS NULL THEN 'invalid' WHEN y.status <> 'active' THEN 'revoked' END AS why
      FROM (SELECT DISTINCT user_id AS k, 'team-' || user_id || '-key' AS raw FROM events UNION ALL SELECT -1, NULL) u LEFT JOIN keys_v y ON y.raw_key = u.raw) q
LEFT JOIN (SELECT * FROM fold WHERE allowed AND us <= epoch_us(timestamp '{AS_OF}') AND us > epoch_us(timestamp '{AS_OF}') - {W_US}) a ON a.k = q.k AND why IS NULL
GROUP BY raw, why""", *sql_decided(), recursive=True)
def w5_status(spark, sf):
    dim = key_dimension(spark, sf)
    known = au.once(au.prepare(rq.validate(_requests(spark, sf))[0], CONFIG).drop("prompt"), dim)
    charged = qt.admitted_entries(au.charge(known, CONFIG))
    users = table(spark, sf, "events").select(F.concat(F.lit("team-"), F.col("user_id").cast("string"), F.lit("-key")).alias("raw_key")).distinct()
    asked = users.unionByName(spark.range(1).select(F.lit(None).cast("string").alias("raw_key")))
    state = qt.key_status(asked, dim, charged.withColumnRenamed("input_tokens", "cost"), AS_OF, SECRET, window_s=WINDOW_S)
    return state.select("masked_key", "http_status", "auth_reason", F.col("rate_limit.limit").alias("token_limit"), "rate_limit.used", "rate_limit.request_count")


# ---------------------------------------------------------------- answers
@query("jn5_response_attach", """
SELECT request_id, CASE WHEN error IS NULL THEN text END AS response, latency_ms AS llm_latency_ms, output_tokens, error IS NOT NULL AS upstream_failed
FROM responses_v""")
def jn5(spark, sf):
    log = view(spark, sf, "responses_v").withColumn("text", F.when(F.col("error").isNull(), F.col("text")))
    return rs.attach_responses(view(spark, sf, "requests_v").select("request_id"), log)


@query("jn6_first_success", """
SELECT request_id, min(model) FILTER (ok) AS model, min(attempt) FILTER (ok) AS won_at, count(*) FILTER (ok) = 0 AS failed,
   coalesce(min(attempt) FILTER (ok) > 1, false) AS fallback,
   coalesce(string_agg(model, ',' ORDER BY attempt) FILTER (NOT ok AND attempt < coalesce(w, 99)), '') AS failures
FROM (SELECT *, min(attempt) FILTER (ok) OVER (PARTITION BY request_id) AS w FROM attempts_v) GROUP BY request_id""")
def jn6(spark, sf):
    first = rs.first_success(view(spark, sf, "attempts_v"))
    return first.select("request_id", "model", "won_at", "failed", "fallback",
                        F.array_join(F.transform("failures", lambda f: f["model"]), ",").alias("failures"))


