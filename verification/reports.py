"""Dashboard, audit log and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptledger.operators import audit_log as log, dashboard as db
from promptledger.sources.search_index import deep_page, search_store, update_search_index
from promptledger.sources.writers import audit_projection, event_json, write_transactions

from .registry import query
from .stores import folder
from .views import AS_OF, view


def half_up(expr: str) -> str:
    """Round a double half-up on its decimal text, as the library does."""
    return f"round(cast(cast({expr} AS varchar) AS decimal(38, 14)), 2)::DOUBLE"


def _txns(spark, sf):
    return view(spark, sf, "transactions_v")


_MEAN = half_up("sum({v}::decimal(18,6)) FILTER ({f})::DOUBLE / count(*) FILTER ({f})")
_OK_MEAN = _MEAN.format(v="processing_time_ms", f="status = 'allowed'")


@query("ag1_kpis", f"""
SELECT count(*) AS total_requests, count(*) FILTER (status = 'allowed') AS allowed_requests,
   count(*) FILTER (status = 'blocked') AS blocked_attacks, sum(redaction_count)::BIGINT AS pii_redactions,
   count(*) FILTER (pii_detected) AS pii_requests, {_OK_MEAN} AS avg_response_time_ms,
   sum(total_tokens)::BIGINT AS total_tokens, count(*) FILTER (status = 'rate_limited') AS rate_limit_violations,
   count(*) FILTER (status IN ('unauthorized', 'forbidden')) AS unauthorized_requests,
   count(*) FILTER (timestamp >= timestamp '{AS_OF}' - interval 1 hour) AS requests_last_hour,
   {half_up("count(*) FILTER (status = 'blocked') / count(*) * 100")} AS block_rate_pct,
   (SELECT round(list_sort(list(processing_time_ms))[cast(ceil(0.95 * count(*)) AS integer)], 2) FROM (SELECT processing_time_ms
      FROM transactions_v WHERE status = 'allowed' ORDER BY timestamp DESC LIMIT 1000)) AS p95_response_time_ms
FROM transactions_v""")
def ag1(spark, sf):
    return db.kpis(_txns(spark, sf), AS_OF)


@query("ag2_conditional_count", """
SELECT user_id, count(*) FILTER (status = 'allowed') AS allowed, count(*) FILTER (pii_detected) AS with_pii,
   count(*) FILTER (status IN ('unauthorized', 'forbidden')) AS rejected FROM transactions_v GROUP BY user_id""")
def ag2(spark, sf):
    return _txns(spark, sf).groupBy("user_id").agg(
        F.count_if(F.col("status") == "allowed").alias("allowed"), F.count_if("pii_detected").alias("with_pii"),
        F.count_if(F.col("status").isin("unauthorized", "forbidden")).alias("rejected"))


@query("ag3_conditional_average", f"SELECT {_OK_MEAN} AS avg_ms, round(max(processing_time_ms), 2) AS max_ms FROM transactions_v")
def ag3(spark, sf):
    rows = _txns(spark, sf)
    slowest = rows.agg(F.round(F.max("processing_time_ms"), 2).alias("max_ms"))
    return slowest.withColumn("avg_ms", db.kpis(rows, AS_OF).select("avg_response_time_ms").scalar())


@query("ag4_block_rate", f"""
SELECT user_id, {half_up("count(*) FILTER (status = 'blocked') / count(*) * 100")} AS block_rate_pct FROM transactions_v GROUP BY user_id""")
def ag4(spark, sf):
    per = _txns(spark, sf).groupBy("user_id").agg(
        F.count_if(F.col("status") == "blocked").alias("b"), F.count("*").alias("n"))
    return per.select("user_id", db.percent(F.col("b"), F.col("n")).alias("block_rate_pct"))


@query("ag5_recent_p95", """
SELECT round(list_sort(list(processing_time_ms))[cast(ceil(0.95 * count(*)) AS integer)], 2) AS p95_response_time_ms
FROM (SELECT processing_time_ms FROM transactions_v WHERE status = 'allowed' ORDER BY timestamp DESC, id DESC LIMIT 1000)""")
def ag5(spark, sf):
    return db.recent_p95(_txns(spark, sf))


def _series_sql(minutes: int, width: int, n: int) -> str:
    start = f"date_trunc('minute', timestamp '{AS_OF}') + interval 1 minute - interval {minutes} minute"
    rate = "coalesce({c}, 0) / " + str(width)
    def per_minute(c):
        return half_up(rate.format(c=c))
    return f"""
SELECT i::INTEGER AS idx, strftime({start} + interval {width} minute * i, '%Y-%m-%dT%H:%M:%S.000Z') AS label,
   {per_minute('t')} AS total, {per_minute('a')} AS allowed, {per_minute('b')} AS blocked, {per_minute('(t - a - b)')} AS throttled,
   avg_ms, p95_ms
FROM range({n}) AS r(i) LEFT JOIN (
  SELECT floor((epoch_us(timestamp) - epoch_us({start})) / {width * 60_000_000}) AS i, count(*) AS t,
     count(*) FILTER (status = 'allowed') AS a, count(*) FILTER (status = 'blocked') AS b, {_OK_MEAN} AS avg_ms,
     round(list_sort(list(processing_time_ms) FILTER (status = 'allowed'))[
        cast(ceil(0.95 * count(*) FILTER (status = 'allowed')) AS integer)], 2) AS p95_ms
  FROM transactions_v WHERE timestamp >= {start} GROUP BY 1) USING (i)"""


@query("ag6_bucket_counts", f"SELECT idx, label, total, allowed, blocked, throttled FROM ({_series_sql(60, 1, 60)})")
def ag6(spark, sf):
    return db.series(_txns(spark, sf), AS_OF, 60).select("idx", "label", "total", "allowed", "blocked", "throttled")


@query("ag7_per_minute_rate", f"SELECT idx, label, total, allowed, blocked, throttled FROM ({_series_sql(360, 5, 72)})")
def ag7(spark, sf):
    return db.series(_txns(spark, sf), AS_OF, 360).select("idx", "label", "total", "allowed", "blocked", "throttled")


@query("ag8_bucket_latency", f"SELECT idx, avg_ms, p95_ms FROM ({_series_sql(1440, 30, 48)})")
def ag8(spark, sf):
    return db.series(_txns(spark, sf), AS_OF, 1440).select("idx", "avg_ms", "p95_ms")


START = "2024-01-10 00:00:00"


@query("ag9_threat_distribution", f"""
SELECT threat_type, count(*) AS n FROM threats_v WHERE timestamp >= timestamp '{START}' GROUP BY threat_type""")
def ag9(spark, sf):
    return db.threat_distribution(view(spark, sf, "threats_v"), START)


_MODELS_SQL = f"""
SELECT m AS target_model, count(*) FILTER (status = 'allowed')::BIGINT AS allowed, count(*) FILTER (status <> 'allowed')::BIGINT AS blocked,
   coalesce({_OK_MEAN}, 0) AS avg_latency_ms
FROM (VALUES ('gpt-4'), ('gemini-pro'), ('claude'), ('llama')) d(m)
LEFT JOIN (SELECT * FROM transactions_v WHERE timestamp >= timestamp '{START}') t ON t.target_model = m GROUP BY m"""


@query("ag10_model_usage", _MODELS_SQL)
def ag10(spark, sf):
    return db.model_usage(_txns(spark, sf), START)


_PII_SQL = f"""
SELECT p AS pii_type, count(id) AS n FROM (VALUES ('EMAIL'), ('PHONE'), ('CREDIT_CARD'), ('SSN')) d(p)
LEFT JOIN transactions_v ON timestamp >= timestamp '{START}' AND list_contains(string_split(pii_types, ','), p) GROUP BY p"""


@query("ag11_pii_distribution", _PII_SQL)
def ag11(spark, sf):
    return db.pii_distribution(_txns(spark, sf), START)


@query("ag12_status_tally", "SELECT status, count(*) AS n FROM transactions_v GROUP BY status")
def ag12(spark, sf):
    return db.status_tally(_txns(spark, sf))


@query("ag13_forwarded_calls", """
SELECT target_model, count(*) FILTER (status IN ('allowed', 'error')) AS calls FROM transactions_v GROUP BY target_model""")
def ag13(spark, sf):
    return db.forwarded_calls(_txns(spark, sf))


@query("ag14_tokens_by_key", """
SELECT masked_api_key, count(*) AS requests, sum(total_tokens)::BIGINT AS total_tokens FROM transactions_v GROUP BY masked_api_key""")
def ag14(spark, sf):
    return db.tokens_by_key(_txns(spark, sf))


@query("jn3_dense_buckets", f"""
SELECT i::INTEGER AS idx, count(id) AS n FROM range(15) r(i) LEFT JOIN transactions_v
  ON floor((epoch_us(timestamp) - epoch_us(timestamp '2024-01-30 12:20:00')) / 60000000) = i GROUP BY i""")
def jn3(spark, sf):
    start, width, n = db.chart_window(AS_OF, 15)
    inside = db.since(_txns(spark, sf), start)
    counts = inside.groupBy(db.bucket_index(F.col("timestamp"), start, width).alias("idx")).agg(F.count("*").alias("n"))
    return db.dense(counts, "idx", n).select("idx", F.coalesce("n", F.lit(0)).alias("n"))


@query("jn4_domain_completion", """
SELECT m AS target_model, count(id) AS n FROM (VALUES ('gpt-4'), ('gemini-pro'), ('claude'), ('llama')) d(m)
LEFT JOIN transactions_v ON target_model = m GROUP BY m""")
def jn4(spark, sf):
    counts = _txns(spark, sf).groupBy("target_model").agg(F.count("*").alias("n"))
    return db.complete(counts, ("gpt-4", "gemini-pro", "claude", "llama"), "target_model", {"n": 0})


@query("w8_anchored_buckets", f"""
SELECT id, floor((epoch_us(timestamp) - epoch_us(timestamp '2024-01-29 12:35:00')) / 1800000000)::INTEGER AS idx FROM transactions_v""")
def w8(spark, sf):
    start, width, _ = db.chart_window(AS_OF, 1440)
    return _txns(spark, sf).select("id", db.bucket_index(F.col("timestamp"), start, width).alias("idx"))


# ---------------------------------------------------------------- filters
def _filtered(name: str, where: str, source: str = "audit_rows_v", **options):
    @query(name, f"SELECT id, timestamp, status FROM {source} WHERE {where}")
    def run(spark, sf):
        return log.audit_filter(view(spark, sf, source), **options).select("id", "timestamp", "status")

    return run


_filtered("flt1_equality", "status = 'blocked' AND target_model = 'claude'", status="blocked", model="claude")
_filtered("flt2_threat_none", "threat_type IS NULL", threat_type="NONE")
_filtered("flt2_threat_equal", "threat_type = 'POLICY_BYPASS'", threat_type="POLICY_BYPASS")
_TEXT = " OR ".join(f"{c} ILIKE '%card%'" for c in log.SEARCHED)
_WILD = " OR ".join(f"{c} ILIKE '%t_x%9%'" for c in log.SEARCHED)
_filtered("flt3_search", _TEXT, search="  CARD ")
_filtered("flt3_wildcards", _WILD, search="T_x%9")
_filtered("flt4_dates", "timestamp >= timestamp '2024-01-05' AND timestamp < timestamp '2024-01-08'",
          date_from="2024-01-05", date_to="2024-01-07")
_filtered("flt4_datetimes", "timestamp >= timestamp '2024-01-05 06:00:00' AND timestamp < timestamp '2024-01-07 18:30:00'",
          date_from="2024-01-05T06:00:00+05:00", date_to="2024-01-07T18:30:00Z")
_filtered("flt5_flags", "pii_detected AND NOT injection_detected", pii=True, injection=False)
_filtered("flt6_combined", f"({_TEXT}) AND status = 'allowed' AND threat_type IS NULL AND pii_detected AND timestamp >= timestamp '2024-01-10'",
          search="card", status="allowed", threat_type="NONE", pii=True, date_from="2024-01-10")


@query("flt7_since", f"SELECT id, timestamp FROM transactions_v WHERE timestamp >= timestamp '{START}'")
def flt7(spark, sf):
    return db.since(_txns(spark, sf), START).select("id", "timestamp")


_PROJECTED = """
SELECT transaction_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.') || lpad(cast((epoch_us(timestamp) // 1000) % 1000 AS varchar), 3, '0') || 'Z' AS timestamp,
   masked_api_key, target_model, status, http_status, round(processing_time_ms, 2) AS processing_time_ms, input_tokens, output_tokens,
   total_tokens, pii_detected, pii_redacted, redaction_count, list_filter(string_split(pii_types, ','), lambda x: x <> '') AS pii_types,
   injection_detected, threat_type, risk_level, masked_ip, prompt_preview FROM audit_rows_v"""


@query("prj7_audit_projection", f"SELECT * REPLACE (array_to_string(pii_types, '|') AS pii_types) FROM ({_PROJECTED})")
def prj7(spark, sf):
    rows = audit_projection(view(spark, sf, "audit_rows_v"))
    return rows.withColumn("pii_types", F.array_join("pii_types", "|"))


@query("snk6_event_json", f"""
SELECT transaction_id, cast(to_json(struct_pack(transaction_id := transaction_id, timestamp := timestamp, masked_api_key := masked_api_key,
   target_model := target_model, status := status, http_status := http_status, processing_time_ms := processing_time_ms,
   input_tokens := input_tokens, output_tokens := output_tokens, total_tokens := total_tokens, pii_detected := pii_detected,
   pii_redacted := pii_redacted, redaction_count := redaction_count, pii_types := pii_types, injection_detected := injection_detected,
   threat_type := threat_type, risk_level := risk_level, masked_ip := masked_ip, prompt_preview := prompt_preview)) AS varchar) AS event
FROM ({_PROJECTED})""")
def snk6(spark, sf):
    return event_json(view(spark, sf, "audit_rows_v"))


# ---------------------------------------------------------------- paging
@query("tk1_audit_page", "SELECT id, timestamp, status FROM audit_rows_v WHERE status = 'blocked' ORDER BY timestamp DESC, id DESC LIMIT 25 OFFSET 50")
def tk1(spark, sf):
    hits = log.audit_filter(view(spark, sf, "audit_rows_v"), status="blocked")
    return log.audit_page(hits, page=3, page_size=25).select("id", "timestamp", "status")


@query("tk1_keyset_page", """
SELECT id, timestamp FROM audit_rows_v WHERE timestamp < timestamp '2024-01-15' OR (timestamp = timestamp '2024-01-15' AND id < 100)
ORDER BY timestamp DESC, id DESC LIMIT 20""")
def tk1_keyset(spark, sf):
    return log.audit_page(view(spark, sf, "audit_rows_v"), after=("2024-01-15 00:00:00", 100)).select("id", "timestamp")


def _store(spark, sf) -> str:
    """The audit rows as a store of some files a day, with its search table; a tenth of the rows is newer than that."""
    path, rows = folder(spark, "log"), view(spark, sf, "audit_rows_v")
    write_transactions(rows.where("id % 10 < 9").repartition("timestamp"), path)
    update_search_index(spark, path)
    write_transactions(rows.where("id % 10 = 9").repartition(F.to_date("timestamp")), path)  # one file a day
    return path


@query("flt3_indexed_search", f"SELECT id, 'id' AS found_by FROM audit_rows_v WHERE transaction_id ILIKE '%00%77%' UNION ALL SELECT id, 'text' FROM audit_rows_v WHERE {_TEXT}")
def flt3_indexed(spark, sf):
    path = _store(spark, sf)
    by_id = search_store(spark, path, "00%77").select("id", F.lit("id").alias("found_by"))
    return by_id.unionByName(search_store(spark, path, "  CARD ").select("id", F.lit("text").alias("found_by")))


@query("tk1_deep_page", "SELECT id, timestamp FROM audit_rows_v WHERE pii_detected ORDER BY timestamp DESC, id DESC LIMIT 20 OFFSET 3980")
def tk1_deep(spark, sf):
    stored = spark.read.parquet(_store(spark, sf))
    return deep_page(log.audit_filter(stored, pii=True), 200, 20).select("id", "timestamp")


@query("tk2_page_totals", "SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM audit_rows_v WHERE pii_detected")
def tk2(spark, sf):
    return log.audit_totals(log.audit_filter(view(spark, sf, "audit_rows_v"), pii=True), 20)


@query("tk3_recent_threats", """
SELECT id, timestamp, threat_type, action, replace(matched_rules, ',', '|') AS rules FROM threats_v ORDER BY timestamp DESC, id DESC LIMIT 50""")
def tk3(spark, sf):
    return log.recent_threats(view(spark, sf, "threats_v"), 50).select(
        "id", "timestamp", "threat_type", "action", F.array_join("matched_rules", "|").alias("rules"))


@query("tk4_latest_1000", """
SELECT id, processing_time_ms FROM transactions_v WHERE status = 'allowed' ORDER BY timestamp DESC, id DESC LIMIT 1000""")
def tk4(spark, sf):
    return db.latest_allowed(_txns(spark, sf)).select("id", "processing_time_ms")


@query("jn2_threat_transaction", """
SELECT t.id, t.threat_type, t.action, x.status, x.target_model FROM threats_v t JOIN transactions_v x USING (transaction_id)""")
def jn2(spark, sf):
    threats = view(spark, sf, "threats_v").select("id", "transaction_id", "threat_type", "action")
    txns = _txns(spark, sf).select("transaction_id", "status", "target_model")
    return log.with_transaction(threats, txns).drop("transaction_id")


@query("jn2_blocked_without_event", """
SELECT id, status FROM transactions_v WHERE status = 'blocked' AND transaction_id NOT IN (
   SELECT transaction_id FROM threats_v WHERE threat_type <> 'POLICY_BYPASS')""")
def jn2_missing(spark, sf):
    kept = view(spark, sf, "threats_v").filter("threat_type <> 'POLICY_BYPASS'")
    return log.blocked_without_event(_txns(spark, sf), kept).select("id", "status")


