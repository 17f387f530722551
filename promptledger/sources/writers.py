"""Writing the audit tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import to_iso
from ..session import checkpointed, shuffles_removed

RULES_CSV_CHARS = 255


#: The batch number of rows that no stream wrote.
NO_BATCH = -1


def write_transactions(txns: DataFrame, path: str, mode: str = "append", batch_id: int = NO_BATCH) -> None:
    """Append audit rows, a folder per day and in it one per stream batch, ordered by time within files.

    Batch jobs and streams share this layout, so both can be read together and a day filter lists one folder. A
    stream batch replaces what it wrote before: `mode="batch"` overwrites only the folders it has rows for.
    """
    rows = txns.withColumn("event_date", F.to_date("timestamp")).withColumn("batch_id", F.lit(batch_id).cast("long"))
    writer = rows.sortWithinPartitions("event_date", "timestamp").write.partitionBy("event_date", "batch_id")
    if mode == "batch":
        writer, mode = writer.option("partitionOverwriteMode", "dynamic"), "overwrite"
    writer.mode(mode).parquet(path)


def write_threats(threats: DataFrame, path: str, mode: str = "append", batch_id: int = NO_BATCH) -> None:
    write_transactions(threats.withColumn("matched_rules", rules_csv(F.col("matched_rules"))), path, mode, batch_id)


def _not_there_yet(rows: DataFrame, path: str, mode: str) -> DataFrame:
    """The rows whose transaction is not stored for that day, so that running twice stores once.

    Only the folders of the days that the rows are of are read.
    """
    if mode != "append":
        return rows
    try:
        there = rows.sparkSession.read.parquet(path).select(F.col("event_date").alias("_day"), F.col("transaction_id").alias("_txn"))
    except AnalysisException:
        return rows
    first, last = rows.agg(F.min(F.to_date("timestamp")), F.max(F.to_date("timestamp"))).first()
    if first is None:
        return rows
    there = there.where(F.col("_day").between(F.lit(first), F.lit(last)))
    same = (F.to_date("timestamp") == F.col("_day")) & (F.col("transaction_id") == F.col("_txn"))
    return rows.join(there, same, "left_anti")


def rejected(quarantine: DataFrame) -> DataFrame:
    """What is kept of rejected requests: id, time and errors; no prompt and no key."""
    return quarantine.select("request_id", "ts", "errors")


def materialised(result):
    """The result with its decided rows in the checkpoint folder, those columns that are stored.

    `write_audit` reads them as they are: for callers who write a result, or parts of it, more than once.
    """
    from ..plans.audit import stored

    return result if result.materialised else replace(result, decided=checkpointed(stored(result.decided)), materialised=True)


def write_audit(result, path: str, mode: str = "append") -> None:
    """Both tables of an audit and the rejected requests under one folder; `mode="overwrite"` empties them first.

    Appending is idempotent: ids are hashes of the requests, and those that are stored already are left out. The
    narrow decided rows are materialised for both tables, unless they are already; `rejected` is replaced by each run.
    """
    from ..plans.audit import build_rows, derive_threats

    decided = materialised(result).decided
    txns, threats = f"{path}/transactions", f"{path}/threat_events"
    with shuffles_removed(decided.sparkSession):
        write_transactions(_not_there_yet(build_rows(decided), txns, mode), txns, mode)
        write_threats(_not_there_yet(derive_threats(decided), threats, mode), threats, mode)
        rejected(result.quarantine).write.mode("overwrite").parquet(f"{path}/rejected")


def rules_csv(rules: Column) -> Column:
    """Rule names joined by commas, cut at 255 characters."""
    return F.left(F.array_join(rules, ","), F.lit(RULES_CSV_CHARS))


def audit_projection(txns: DataFrame) -> DataFrame:
    """The 19 fields that may leave the audit store."""
    kind = txns.schema["pii_types"].dataType.typeName()
    types = F.col("pii_types") if kind == "array" else F.split("pii_types", ",")
    return txns.select(
        "transaction_id", to_iso(F.col("timestamp")).alias("timestamp"), "masked_api_key", "target_model", "status",
        "http_status", F.round(F.coalesce("processing_time_ms", F.lit(0.0)), 2).alias("processing_time_ms"),
        "input_tokens", "output_tokens", "total_tokens", "pii_detected", "pii_redacted", "redaction_count",
        F.filter(F.coalesce(types, F.array().cast("array<string>")), lambda t: t != "").alias("pii_types"),
        "injection_detected", "threat_type", "risk_level", "masked_ip", "prompt_preview")


def event_json(txns: DataFrame) -> DataFrame:
    """One compact JSON document per audit row; null fields stay in it."""
    rows = audit_projection(txns)
    body = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.select("transaction_id", body.alias("event"))
