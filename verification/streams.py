"""Streaming operators, run over the given tables until the source is drained."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, functions as F

from promptledger.functions import injection as inj, pii
from promptledger.session import use_checkpoint_dir
from promptledger.operators import dashboard as db, quota as qt
from promptledger.streaming import admission, budgets, live

from .decisions import CONFIG, _HITS, _requests, key_dimension, sql_decided, sql_fold
from .injections import HITS
from .personal_data import _ALL, _expected
from .registry import query
from .reports import START, _MODELS_SQL, _PII_SQL, _PROJECTED, _series_sql
from .views import AS_OF, VIEWS, WINDOW_S, table, view


def stream_of(spark, sf, name) -> DataFrame:
    """A given table as a file stream."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}*.parquet")


def stream_folder(spark) -> str:
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


@contextmanager
def slot_partitions(spark):
    """A stream keeps its number of state partitions for good and has no adaptive merging: size it to the slots."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(before), spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def drained(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream to its end and read back what it wrote to the shared folder."""
    spark = stream.sparkSession
    folder = folder or stream_folder(spark)
    sink = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True)
    with slot_partitions(spark):
        if mode == "append":
            run = sink.format("parquet").start(f"{folder}/out")
        else:
            run = sink.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out")).start()
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("st1_stream_detect", "SELECT request_id, string_agg(name, ',' ORDER BY pos) AS rules FROM hits GROUP BY request_id",
       *[h.replace("requests_v", "(SELECT event_id AS request_id, t AS prompt FROM events JOIN prompt_pool ON i = event_id % 16)") for h in HITS])
def st1(spark, sf):
    pool = view(spark, sf, "prompt_pool")
    events = stream_of(spark, sf, "events").select(F.col("event_id").alias("request_id"), (F.col("event_id") % 16).alias("i"))
    prompts = events.join(pool, "i").select("request_id", F.col("t").alias("prompt"))
    found = inj.detect(pii.scrub(prompts, "prompt"), "prompt").filter("injection.detected")
    return drained(found.select("request_id", F.array_join("injection.matched_rules", ",").alias("rules")))


@query("st2_stream_admission", "SELECT k, id, allowed, used FROM fold", *sql_fold(_HITS), recursive=True)
def st2(spark, sf):
    admission.use_rocksdb(spark)
    hits = stream_of(spark, sf, "events").selectExpr(
        "event_id AS id", "user_id AS k", "ts", "cast(1 + floor(value) AS int) AS cost")
    done = admission.admit_stream(hits, "k", "ts", "id", "cost", window_s=WINDOW_S)
    return drained(done.select("k", "id", "quota.allowed", "quota.used"))




#: Rows of a file of a part, at least. A file is read by one task, so parts have as many as there are slots as soon as they can.
FILE_ROWS = 10_000


def in_parts(rows: DataFrame, by: str, n: int, name: str) -> DataFrame:
    """The rows as a stream of `n` parts, one micro-batch each, cut at equal steps of `by` and written in that order."""
    return parts(rows, by, n, name)[0]


def parts(rows: DataFrame, by: str, n: int, name: str) -> tuple[DataFrame, str]:
    """`in_parts`, and the folder that the stream reads."""
    spark = rows.sparkSession
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    us = F.unix_micros(F.col(by).cast("timestamp"))
    low, high = rows.agg(F.min(us), F.max(us)).first()
    step = (high - low) // n + 1
    # As many files in each part, which the rows of the smallest part fill for certain.
    sizes = [r["count"] for r in rows.groupBy(F.floor((us - low) / step)).count().collect()]  # n rows
    files = max(1, min(min(sizes) // FILE_ROWS, spark.sparkContext.defaultParallelism)) if len(sizes) == n else 1
    for i in range(n):
        rows.where((us >= low + i * step) & (us < low + (i + 1) * step)).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder), folder


@query("st1_stream_scrub", f"SELECT id, {_expected(*_ALL)} AS redacted_text FROM pii_notes_v")
def st1_scrub(spark, sf):
    """Notes over a stream of orders, redacted."""
    notes = spark.sql("WITH orders AS (SELECT * FROM {orders})" + f", pii_notes_v AS ({VIEWS['pii_notes_v']}) SELECT * FROM pii_notes_v",
                      orders=stream_of(spark, sf, "orders"))
    return drained(pii.scrub(notes, "text").select("id", "pii.redacted_text"))


@query("st2_stream_batches", "SELECT k, id, allowed, used FROM fold", *sql_fold(_HITS), recursive=True)
def st2_batches(spark, sf):
    """Admission over four micro-batches: windows live on in the state between them."""
    admission.use_rocksdb(spark)
    hits = in_parts(view(spark, sf, "quota_hits_v"), "ts", 4, "hits")
    done = admission.admit_stream(hits, "k", "ts", "id", "cost", window_s=WINDOW_S)
    return drained(done.select("k", "id", "quota.allowed", "quota.used"))


@query("st6_fan_out", """
SELECT request_id AS id, status, CASE WHEN status = 'allowed' THEN output_tokens ELSE 0 END::INTEGER AS output_tokens
FROM decided JOIN responses_v USING (request_id)""", *sql_decided(), recursive=True)
def st6(spark, sf):
    """The whole audit on a stream, with logged answers, read back from its tables."""
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/audit-{uuid.uuid4().hex}"
    requests = in_parts(_requests(spark, sf), "ts", 2, "requests")
    with slot_partitions(spark):
        live.start_audit(requests, key_dimension(spark, sf).checkpoint(), CONFIG, folder, f"{folder}/ck", {"availableNow": True},
                         view(spark, sf, "responses_v")).awaitTermination()
    return spark.read.parquet(f"{folder}/transactions").select("id", "status", "output_tokens")


@query("st3_live_feed", f"SELECT transaction_id, timestamp, status, total_tokens::BIGINT AS total_tokens FROM ({_PROJECTED})")
def st3(spark, sf):
    """The feed's JSON, parsed again."""
    from promptledger.sources.writers import event_json

    events = stream_of(spark, sf, "events")
    rows = _over(spark, events, "audit_rows_v")
    fed = drained(event_json(rows).select("event"))
    return fed.select(F.from_json("event", "transaction_id string, timestamp string, status string, total_tokens long").alias("e")).select("e.*")


@query("st4_live_series", """
SELECT date_trunc('hour', timestamp)::TIMESTAMP AS bucket_start, count(*) AS total, count(*) FILTER (status = 'allowed') AS allowed,
   count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status NOT IN ('allowed', 'blocked')) AS throttled
FROM transactions_v GROUP BY ALL""")
def st4(spark, sf):
    rows = _over(spark, stream_of(spark, sf, "events"), "transactions_v")
    return drained(live.live_series(rows, width="1 hour"), "complete")


@query("st5_recent_buffer", "SELECT id, timestamp, status FROM transactions_v ORDER BY timestamp DESC, id DESC LIMIT 100")
def st5(spark, sf):
    rows = _over(spark, stream_of(spark, sf, "events"), "transactions_v").select("id", "timestamp", "status")
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/recent-{uuid.uuid4().hex}"
    rows.writeStream.option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).foreachBatch(
        lambda df, i: live.keep_recent(df, f"{folder}/buffer", 100, i)).start().awaitTermination()
    return live.read_recent(spark, f"{folder}/buffer")


def _over(spark, events: DataFrame, name: str) -> DataFrame:
    """A view of events, over a stream of them."""
    ctes = ["events AS (SELECT * FROM {events})", f"transactions_v AS ({VIEWS['transactions_v']})", f"audit_rows_v AS ({VIEWS['audit_rows_v']})"]
    return spark.sql("WITH " + ",\n".join(ctes) + f"\nSELECT * FROM {name}", events=events)


# ---------------------------------------------------------------- budgets in the order of request time
LATENESS_S, FILES = 3 * 86_400, 4
#: How long after its time a request arrives, in hours: shuffled within the allowed lateness, some far behind it.
_DELAY_H = "CASE WHEN id % 23 = 5 THEN 240 + id % 7 * 24 ELSE id * 37 % 70 END"


def _heartbeat(rows: DataFrame, at: str) -> DataFrame:
    """A row without a key, which only moves the clock."""
    return rows.sparkSession.sql(f"SELECT -1L AS id, NULL AS k, timestamp_ntz '{at}' AS ts, 0 AS cost").select(
        *[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in ("id", "k", "ts", "cost")])


def _with_clock(stream: DataFrame, folder: str, at: str) -> None:
    """One more file for the stream's folder: a heartbeat."""
    _heartbeat(stream, at).select(*[F.col(c) if c in ("id", "k", "ts", "cost") else F.lit(None).cast(stream.schema[c].dataType).alias(c)
                                    for c in stream.columns]).coalesce(1).write.mode("append").parquet(folder)


_ARRIVALS = [
    f"arrivals AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) + ({_DELAY_H}) * 3600000000 AS arr FROM quota_hits_v)",
    f"cuts AS (SELECT min(arr) AS low, (max(arr) - min(arr)) // {FILES} + 1 AS step FROM arrivals)",
    "filed AS (SELECT a.*, (arr - low) // step AS f FROM arrivals a, cuts)",
    "clock AS (SELECT f, max(max(us)) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM filed GROUP BY f)",
    f"judged AS (SELECT d.*, coalesce(us < seen // 1000 * 1000 - {LATENESS_S} * 1000000::BIGINT, false) AS late FROM filed d JOIN clock USING (f))",
]


@query("st7_late_requests", """
SELECT id, k, late, allowed, used FROM judged LEFT JOIN (SELECT id AS i, allowed, used FROM fold) ON i = id""",
       *_ARRIVALS, *sql_fold("SELECT k, id, us, cost, 100 AS lim FROM judged WHERE NOT late"), recursive=True)
def st7(spark, sf):
    """Shuffled micro-batches: decided in the order of request time, those too late to be decided told apart."""
    admission.use_rocksdb(spark)
    hits = view(spark, sf, "quota_hits_v")
    arrives = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.expr(_DELAY_H).cast("long") * 3_600_000_000)
    stream, folder = parts(hits.withColumn("arrives", arrives), "arrives", FILES, "late")
    _with_clock(stream, folder, "2034-01-01 00:00:00")
    done = budgets.admit_in_order(stream.drop("arrives"), "k", "ts", "id", "cost", lateness_s=LATENESS_S, window_s=WINDOW_S)
    return drained(done).where("k is not null").select("id", "k", "late", "quota.allowed", "quota.used")


@query("st2_opening_state", f"""
SELECT k, id, allowed, used FROM fold WHERE us >= epoch_us(timestamp '{AS_OF}')""", *sql_fold(_HITS), recursive=True)
def st2_opening(spark, sf):
    """A stream that starts where a batch ended goes on with the batch's windows."""
    admission.use_rocksdb(spark)
    hits, cut = view(spark, sf, "quota_hits_v"), F.lit(AS_OF).cast("timestamp_ntz")
    before = qt.admitted_entries(qt.admissions(hits.where(F.col("ts") < cut), "k", "ts", "id", "cost", window_s=WINDOW_S))
    stream, folder = parts(hits.where(F.col("ts") >= cut), "ts", 2, "after")
    _with_clock(stream, folder, "2034-01-01 00:00:00")
    done = budgets.admit_in_order(stream, "k", "ts", "id", "cost", lateness_s=3600, window_s=WINDOW_S, opening=before.select("k", "ts", "cost"))
    return drained(done).where("k is not null").select("k", "id", "quota.allowed", "quota.used")


#: Just behind AS_OF: what the streams below have decided when they are asked.
_JUST_AFTER = AS_OF + ".001"


def _peeked(spark, hits: DataFrame, **options) -> DataFrame:
    """The state that a stream of the hits up to AS_OF leaves behind, asked for from its checkpoint."""
    admission.use_rocksdb(spark)
    stream, folder = parts(hits.where(F.col("ts") <= F.lit(AS_OF).cast("timestamp_ntz")), "ts", 3, "peek")
    _with_clock(stream, folder, AS_OF.replace("12:34", "13:34") + ".001")
    at = stream_folder(spark)
    drained(budgets.admit_in_order(stream, "k", "ts", "id", "cost", lateness_s=3600, window_s=WINDOW_S, **options), folder=at)
    keys = hits.select(F.col("k").alias("key"), F.lit(None).cast("int").alias("rate_limit")).distinct()
    state = budgets.peek(spark, f"{at}/ck", keys, _JUST_AFTER, window_s=WINDOW_S)
    return state.select(F.col("key").alias("k"), "used", "remaining", "request_count", F.col("reset_in_seconds").cast("double").alias("reset_in_seconds"))


_PEEK = """
SELECT q.k, coalesce(sum(cost), 0)::BIGINT AS used, greatest(0, 100 - coalesce(sum(cost), 0))::BIGINT AS remaining, count(us)::INTEGER AS request_count,
   coalesce(greatest(0, min(us) + {wus} - epoch_us(timestamp '{now}')) / 1e6, 0)::DOUBLE AS reset_in_seconds
FROM (SELECT DISTINCT k FROM quota_hits_v) q LEFT JOIN (
   SELECT k AS kk, us, cost FROM fold WHERE allowed AND us <= epoch_us(timestamp '{now}') AND us > epoch_us(timestamp '{now}') - {wus} AND {extra}) e ON kk = q.k
GROUP BY q.k"""


@query("w5_stream_peek", _PEEK.format(wus=WINDOW_S * 1_000_000, now=_JUST_AFTER, extra="true"), *sql_fold(_HITS), recursive=True)
def w5_stream(spark, sf):
    return _peeked(spark, view(spark, sf, "quota_hits_v"))


_RESETS = """SELECT k, us FROM (SELECT DISTINCT k FROM quota_hits_v) r, (VALUES (epoch_us(timestamp '2024-01-29 18:00:00'), 1),
   (epoch_us(timestamp '2024-01-30 06:00:00'), 3)) AS t(us, every) WHERE k % every = 0"""


def sql_fold_with_resets() -> list[str]:
    """The admission recurrence over hits and resets; a reset comes after the hits of its time."""
    live = f"list_filter(f.live, lambda e: e.us > h.us - {WINDOW_S * 1_000_000})"
    used = f"coalesce(list_sum(list_transform({live}, lambda e: e.cost)), 0)"
    entry = "{'us': h.us, 'cost': h.cost::BIGINT}"
    return [
        f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY us, id IS NULL, id) AS rn FROM (
  {_HITS} UNION ALL SELECT k, NULL, us, 0, 100 FROM ({_RESETS})))""",
        f"""fold AS (
  SELECT k, rn, id, us, cost, CASE WHEN id IS NOT NULL AND h.cost <= lim THEN [{entry}] ELSE [] END AS live, id IS NOT NULL AND cost <= lim AS allowed
  FROM numbered h WHERE rn = 1
  UNION ALL
  SELECT h.k, h.rn, h.id, h.us, h.cost, CASE WHEN h.id IS NULL THEN [] WHEN {used} + h.cost <= h.lim THEN list_append({live}, {entry}) ELSE {live} END,
     h.id IS NOT NULL AND {used} + h.cost <= h.lim
  FROM fold f JOIN numbered h ON h.k = f.k AND h.rn = f.rn + 1)""",
    ]


@query("w6_stream_reset", _PEEK.format(wus=WINDOW_S * 1_000_000, now=_JUST_AFTER, extra=f"""NOT EXISTS (
      SELECT 1 FROM ({_RESETS}) r WHERE r.k = fold.k AND r.us >= fold.us AND r.us <= epoch_us(timestamp '{_JUST_AFTER}'))"""),
       *sql_fold_with_resets(), recursive=True)
def w6_stream(spark, sf):
    """Budgets emptied while the stream runs, of all keys and of some, and then asked for."""
    hits = view(spark, sf, "quota_hits_v")
    keys = hits.select("k").distinct()
    some = keys.where("k % 3 = 0").withColumn("reset_at", F.lit("2024-01-30 06:00:00").cast("timestamp_ntz"))
    whole = spark.range(1).select(F.lit(None).cast("bigint").alias("k"), F.lit("2024-01-29 18:00:00").cast("timestamp_ntz").alias("reset_at"))
    resets, _ = parts(whole.unionByName(some), "reset_at", 1, "resets")
    return _peeked(spark, hits, resets=resets, all_keys=keys)


# ---------------------------------------------------------------- live charts
def _cells(spark, sf) -> DataFrame:
    """The counts that a stream of four micro-batches of transactions keeps."""
    at = stream_folder(spark)
    rows = in_parts(view(spark, sf, "transactions_v"), "timestamp", 4, "txns")
    with slot_partitions(spark):
        live.live_cells(rows).writeStream.outputMode("update").option("checkpointLocation", f"{at}/ck").trigger(availableNow=True).foreachBatch(
            lambda df, i: live.keep_cells(df, f"{at}/cells", i)).start().awaitTermination()
    return live.read_cells(spark, f"{at}/cells")


@query("st4_live_latency", f"SELECT * FROM ({_series_sql(1440, 30, 48)})")
def st4_latency(spark, sf):
    """Rates, mean and p95 latency of every bucket of the chart, from what the stream has counted."""
    return db.series(_cells(spark, sf), AS_OF, 1440, stats=db.cell_stats)


@query("st4_live_models", _MODELS_SQL)
def st4_models(spark, sf):
    return db.cell_model_usage(_cells(spark, sf), START)


@query("st4_live_pii", _PII_SQL)
def st4_pii(spark, sf):
    return db.cell_pii_distribution(_cells(spark, sf), START)
