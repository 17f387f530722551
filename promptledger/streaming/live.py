"""The audit pipeline and the dashboard on streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dashboard import cells
from ..operators.keys import resolve_keys
from ..operators.requests import validate
from ..operators.responses import attach_responses
from ..plans.audit import ANSWER_FIELDS, AuditConfig, build_rows, decide, derive_threats, prepare, score, threat
from ..sources.writers import event_json, rejected, write_threats, write_transactions
from .admission import admit_stream, use_rocksdb


def decided_stream(requests: DataFrame, keys: DataFrame, config: AuditConfig, responses: DataFrame | None = None) -> DataFrame:
    """Every valid request of the stream, decided: same columns as the batch pipeline's `decided`.

    `responses`, a table of logged answers, is joined as it stands when a batch runs; what is answered later is
    brought in by a batch audit of the same requests, which has the same ids.
    """
    valid, _ = validate(requests, config.max_prompt_chars)
    rows = resolve_keys(score(prepare(valid, config), config), keys)
    rows = rows.withColumn("_ok", F.col("auth_reason").isNull())
    charged = admit_stream(rows, "key_hash", "ts", "request_id", "input_tokens", "key_limit", charge="_ok",
                           default_limit=config.default_limit, window_s=config.window_s).drop("_ok")
    if responses is not None:
        charged = attach_responses(charged, responses)
    else:
        charged = charged.withColumns({c: F.lit(None).cast(t) for c, t in ANSWER_FIELDS.items()})
    return threat(decide(charged))


def write_batch(decided: DataFrame, batch_id: int, path: str) -> None:
    """Fan one micro-batch out to transactions, threat events and the JSON feed.

    Each batch owns a folder per day and table and overwrites it, so a repeated batch leaves no duplicates.
    """
    decided.persist()
    try:
        txns = build_rows(decided)
        write_transactions(txns, f"{path}/transactions", "batch", batch_id)
        write_threats(derive_threats(decided), f"{path}/threat_events", "batch", batch_id)
        event_json(txns).select("event").write.mode("overwrite").text(f"{path}/feed/batch_id={batch_id}")
    finally:
        decided.unpersist()


def start_audit(requests: DataFrame, keys: DataFrame, config: AuditConfig, path: str, checkpoint: str,
                trigger: dict | None = None, responses: DataFrame | None = None) -> StreamingQuery:
    """Run the pipeline on a request stream and keep the audit tables under `path`."""
    use_rocksdb(requests.sparkSession)
    writer = decided_stream(requests, keys, config, responses).writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).foreachBatch(
        lambda batch, batch_id: write_batch(batch, batch_id, path)).start()


def start_rejected(requests: DataFrame, config: AuditConfig, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep what the stream's validation turns away: ids, times and errors."""
    _, bad = validate(requests, config.max_prompt_chars)
    return rejected(bad).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"processingTime": "10 seconds"})).start(path)


def live_feed(txns: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each new audit row once, as a JSON line."""
    events = event_json(txns).select(F.col("event").alias("value"))
    return events.writeStream.format("text").outputMode("append").option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"processingTime": "5 seconds"})).start(path)


def live_series(txns: DataFrame, watermark: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Counts per bucket that follow new rows; write it in update mode. Rows later than the watermark are dropped."""
    status = F.col("status")
    clocked = txns.withColumn("timestamp", F.col("timestamp").cast("timestamp"))  # watermarks need a time zone
    counts = clocked.withWatermark("timestamp", watermark).groupBy(F.window("timestamp", width)).agg(
        F.count("*").alias("total"), F.count_if(status == "allowed").alias("allowed"),
        F.count_if(status == "blocked").alias("blocked"),
        F.count_if(~status.isin("allowed", "blocked")).alias("throttled"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("bucket_start"), "total", "allowed", "blocked", "throttled")


# ---------------------------------------------------------------- live charts
_CELL = ["minute", "status", "target_model", "ms", "pii_types"]


def live_cells(txns: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """`dashboard.cells` that follow new rows; write them in update mode with `keep_cells`.

    The state holds a count for each minute, outcome and hundredth of a millisecond, whatever the number of rows, until the
    watermark has passed the minute. Rows later than that are dropped.
    """
    clocked = txns.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", watermark)
    held = cells(clocked, F.window("timestamp", "1 minute"))
    return held.withColumn("minute", F.col("minute.start").cast("timestamp_ntz"))


def keep_cells(batch: DataFrame, path: str, batch_id: int) -> None:
    """For `foreachBatch`: the cells that a micro-batch has changed, as they stand now. A repeated batch replaces its own."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells as the last micro-batch left them, for `dashboard.series(..., stats=cell_stats)` and the other charts."""
    rows = spark.read.parquet(path)
    last = F.max_by(F.struct("n", "sum_ms"), "batch_id").alias("last")
    return rows.groupBy(*_CELL).agg(last).select(*_CELL, "last.n", "last.sum_ms")


# ---------------------------------------------------------------- recent buffer
def _slots(spark: SparkSession, path: str) -> list[tuple[int, str, DataFrame]]:
    """The buffer's readable slots as (epoch, folder, rows), newest first."""
    found = []
    for slot in ("a", "b"):
        try:
            rows = spark.read.parquet(f"{path}/{slot}")
        except AnalysisException:
            continue
        epoch = rows.agg(F.max("_epoch")).first()[0]
        if epoch is not None:
            found.append((epoch, slot, rows))
    return sorted(found, key=lambda s: -s[0])


def keep_recent(batch: DataFrame, path: str, n: int = 100, batch_id: int = 0) -> None:
    """For `foreachBatch`: keep the latest `n` rows by (timestamp, id), dropping the oldest.

    The buffer has two slots. A batch reads the newest one older than itself and writes the other, so a
    failed or repeated batch never loses the buffer.
    """
    if n < 1:
        raise ValueError("n is at least 1")
    base = [s for s in _slots(batch.sparkSession, path) if s[0] < batch_id]
    rows = batch.unionByName(base[0][2].drop("_epoch")) if base else batch
    target = "b" if base and base[0][1] == "a" else "a"
    top = rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)
    top.withColumn("_epoch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/{target}")


def read_recent(spark: SparkSession, path: str) -> DataFrame:
    """The buffer, newest first."""
    return _slots(spark, path)[0][2].drop("_epoch").orderBy(F.desc("timestamp"), F.desc("id"))
