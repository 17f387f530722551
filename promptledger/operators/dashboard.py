"""KPIs, dense time series and distributions over the audit tables.

Means are exact: latencies are added as decimals, so a result does not depend on the order in which a
shuffle delivers rows. Rounding is half-up everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import bucket_minutes, nearest_rank, to_iso
from ..schemas import MODEL_NAMES, PII_TYPES, THREAT_TYPES

LATEST = 1000


def _moment(value: datetime | str) -> datetime:
    return datetime.fromisoformat(value) if isinstance(value, str) else value


def _ntz(value: datetime) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def _when(cond: Column) -> Column:
    return F.count_if(cond)


def _exact(c: Column) -> Column:
    return c.cast("decimal(18,6)")


def _mean(total: Column, n: Column) -> Column:
    return F.round(total.cast("double") / n, 2)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent to 2 places; 0 of nothing."""
    return F.when(whole > 0, F.round(part / whole * 100, 2)).otherwise(F.lit(0.0))


def latest_allowed(txns: DataFrame, n: int = LATEST) -> DataFrame:
    """The latest `n` allowed requests."""
    allowed = txns.filter(F.col("status") == "allowed").select("timestamp", "id", "processing_time_ms")
    return allowed.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def recent_p95(txns: DataFrame, n: int = LATEST) -> DataFrame:
    """p95 latency of the latest `n` allowed requests, one row."""
    return latest_allowed(txns, n).agg(nearest_rank("processing_time_ms", 95).alias("p95_response_time_ms"))


def kpis(txns: DataFrame, as_of: datetime | str) -> DataFrame:
    """The headline row: one aggregation pass plus a top-1000 for the percentile."""
    status, ok = F.col("status"), F.col("status") == "allowed"
    hour_ago = _ntz(_moment(as_of) - timedelta(hours=1))
    one = txns.agg(
        F.count("*").alias("total_requests"),
        _when(ok).alias("allowed_requests"),
        _when(status == "blocked").alias("blocked_attacks"),
        F.coalesce(F.sum("redaction_count"), F.lit(0)).cast("long").alias("pii_redactions"),
        _when(F.col("pii_detected")).alias("pii_requests"),
        F.coalesce(_mean(F.sum(F.when(ok, _exact(F.col("processing_time_ms")))),
                         F.count(F.when(ok, F.col("processing_time_ms")))), F.lit(0.0)).alias("avg_response_time_ms"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("total_tokens"),
        _when(status == "rate_limited").alias("rate_limit_violations"),
        _when(status.isin("unauthorized", "forbidden")).alias("unauthorized_requests"),
        _when(F.col("timestamp") >= hour_ago).alias("requests_last_hour"))
    return one.withColumn("block_rate_pct", percent(F.col("blocked_attacks"), F.col("total_requests"))).withColumn(
        "p95_response_time_ms", recent_p95(txns).scalar())


# ---------------------------------------------------------------- time series
def chart_window(as_of: datetime | str, window_minutes: int = 60) -> tuple[datetime, int, int]:
    """Start of the chart, bucket width in minutes and number of buckets; buckets count from the start."""
    width = bucket_minutes(window_minutes)
    end = _moment(as_of).replace(second=0, microsecond=0) + timedelta(minutes=1)
    return end - timedelta(minutes=window_minutes), width, -(-window_minutes // width)


def bucket_index(ts: Column, start: datetime, width: int) -> Column:
    """Anchored tumbling bucket number of a timestamp; outside 0..n-1 when not on the chart."""
    offset = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(_ntz(start).cast("timestamp"))
    return F.floor(offset / (width * 60_000_000)).cast("int")


def since(df: DataFrame, start: datetime | str) -> DataFrame:
    """Rows from `start` on; there is no upper bound."""
    return df.filter(F.col("timestamp") >= _ntz(_moment(start)))


def dense(df: DataFrame, idx: str, n: int) -> DataFrame:
    """One row per bucket 0..n-1, whether or not the frame has it."""
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias(idx)).join(df, idx, "left")


def complete(df: DataFrame, domain: Sequence[str], col: str, zeros: dict[str, object]) -> DataFrame:
    """One row per member of a fixed domain in its order, defaults where the frame has none."""
    members = df.sparkSession.createDataFrame([(i, m) for i, m in enumerate(domain)], f"_at int, {col} string")
    full = members.join(df, col, "left").orderBy("_at")
    return full.select(col, *[F.coalesce(c, F.lit(z)).alias(c) for c, z in zeros.items()])


def bucket_stats(txns: DataFrame, start: datetime, width: int, n: int) -> DataFrame:
    """Counts, mean and p95 latency per bucket that has rows.

    Rows are first counted per (bucket, latency in hundredths), which spreads a busy bucket over all
    tasks. Ranking then works on distinct latencies, not on rows.
    """
    ok = F.col("status") == "allowed"
    ms = F.when(ok, F.coalesce("processing_time_ms", F.lit(0.0)))
    inside = since(txns, start).filter(F.col("timestamp") < _ntz(start + timedelta(minutes=width * n)))
    return _ranked(inside.groupBy(bucket_index(F.col("timestamp"), start, width).alias("idx"), F.round(ms, 2).alias("ms")).agg(
        F.count("*").alias("n"), _when(ok).alias("n_allowed"), _when(F.col("status") == "blocked").alias("n_blocked"),
        F.sum(_exact(ms)).alias("sum_ms")))


def _ranked(cells: DataFrame) -> DataFrame:
    """The statistics of buckets from counts per (`idx`, `ms`)."""
    by_latency = Window.partitionBy("idx").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("seen", F.sum("n_allowed").over(by_latency)).withColumn(
        "of", F.sum("n_allowed").over(Window.partitionBy("idx")))
    rank = F.floor((F.col("of") * 95 + 99) / 100)
    return ranked.groupBy("idx").agg(
        F.sum("n").alias("total"), F.sum("n_allowed").alias("allowed"), F.sum("n_blocked").alias("blocked"),
        _mean(F.sum("sum_ms"), F.sum("n_allowed")).alias("avg_ms"),
        F.min(F.when((F.col("n_allowed") > 0) & (F.col("seen") >= rank), F.col("ms"))).alias("p95_ms"))


# ---------------------------------------------------------------- mergeable counts
def cells(txns: DataFrame, minute: Column) -> DataFrame:
    """What the charts need of any number of rows: `n` rows and the exact sum `sum_ms` of their latencies per `minute`, status,
    model, latency in hundredths (null unless allowed) and set of PII types. Counts of parts add up to those of the whole."""
    ok = F.col("status") == "allowed"
    ms = F.when(ok, F.coalesce("processing_time_ms", F.lit(0.0)))
    kind = txns.schema["pii_types"].dataType.typeName()
    types = F.array_join("pii_types", ",") if kind == "array" else F.coalesce("pii_types", F.lit(""))
    return txns.groupBy(minute.alias("minute"), "status", "target_model", F.round(ms, 2).alias("ms"), types.alias("pii_types")).agg(
        F.count("*").alias("n"), F.sum(_exact(ms)).alias("sum_ms"))


def _cells_since(held: DataFrame, start: datetime | str) -> DataFrame:
    return held.filter(F.col("minute") >= _ntz(_moment(start)))


def cell_stats(held: DataFrame, start: datetime, width: int, n: int) -> DataFrame:
    """`bucket_stats` from `cells`; charts begin at a full minute, so no cell lies in two buckets."""
    inside = _cells_since(held, start).filter(F.col("minute") < _ntz(start + timedelta(minutes=width * n)))
    return _ranked(inside.groupBy(bucket_index(F.col("minute"), start, width).alias("idx"), "ms").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("status") == "allowed", F.col("n")).otherwise(0)).alias("n_allowed"),
        F.sum(F.when(F.col("status") == "blocked", F.col("n")).otherwise(0)).alias("n_blocked"), F.sum("sum_ms").alias("sum_ms")))


def cell_model_usage(held: DataFrame, start: datetime | str) -> DataFrame:
    """`model_usage` from `cells`; `start` is a full minute."""
    n_ok = F.when(F.col("status") == "allowed", F.col("n")).otherwise(0)
    usage = _cells_since(held, start).filter(F.col("target_model").isin(*MODEL_NAMES)).groupBy("target_model").agg(
        F.sum(n_ok).alias("allowed"), F.sum(F.col("n") - n_ok).alias("blocked"), F.when(F.sum(n_ok) > 0, _mean(F.sum("sum_ms"), F.sum(n_ok))).alias("avg_latency_ms"))
    return complete(usage, tuple(MODEL_NAMES), "target_model", {"allowed": 0, "blocked": 0, "avg_latency_ms": 0.0})


def cell_pii_distribution(held: DataFrame, start: datetime | str) -> DataFrame:
    """`pii_distribution` from `cells`; `start` is a full minute."""
    counts = _cells_since(held, start).select(F.explode(F.split("pii_types", ",")).alias("pii_type"), "n").groupBy("pii_type").agg(F.sum("n").alias("n"))
    return complete(counts, PII_TYPES, "pii_type", {"n": 0})


def series(txns: DataFrame, as_of: datetime | str, window_minutes: int = 60, stats=bucket_stats) -> DataFrame:
    """Per bucket: requests per minute by outcome, mean and p95 latency; empty buckets count 0, latency null.

    `throttled` is everything neither allowed nor blocked. With `stats=cell_stats` the first argument is `cells`.
    """
    start, width, n = chart_window(as_of, window_minutes)
    full = dense(stats(txns, start, width, n), "idx", n)
    zero = F.lit(0).cast("long")
    total, allowed, blocked = (F.coalesce(F.col(c), zero) for c in ("total", "allowed", "blocked"))

    def rate(c: Column) -> Column:
        return F.round(c / width, 2)

    begin = F.timestamp_micros(F.unix_micros(_ntz(start).cast("timestamp")) + F.col("idx").cast("long") * (width * 60_000_000))
    return full.orderBy("idx").select(
        "idx", to_iso(begin).alias("label"), rate(total).alias("total"), rate(allowed).alias("allowed"),
        rate(blocked).alias("blocked"), rate(total - allowed - blocked).alias("throttled"), "avg_ms", "p95_ms")


# ---------------------------------------------------------------- distributions
def threat_distribution(threats: DataFrame, start: datetime | str) -> DataFrame:
    """Events per threat type: known types in display order, then others; types without events are left out."""
    known = F.array_position(F.array(*[F.lit(t) for t in THREAT_TYPES]), F.col("threat_type"))
    counts = since(threats, start).groupBy("threat_type").agg(F.count("*").alias("n"))
    return counts.orderBy(F.when(known > 0, known).otherwise(len(THREAT_TYPES) + 1), "threat_type")


def model_usage(txns: DataFrame, start: datetime | str) -> DataFrame:
    """Per known model: allowed, not allowed (`blocked`) and mean latency of the allowed."""
    ok = F.col("status") == "allowed"
    ms = F.when(ok, F.coalesce("processing_time_ms", F.lit(0.0)))
    usage = since(txns, start).filter(F.col("target_model").isin(*MODEL_NAMES)).groupBy("target_model").agg(
        _when(ok).alias("allowed"), _when(~ok).alias("blocked"),
        _mean(F.sum(_exact(ms)), F.count(ms)).alias("avg_latency_ms"))
    return complete(usage, tuple(MODEL_NAMES), "target_model", {"allowed": 0, "blocked": 0, "avg_latency_ms": 0.0})


def pii_distribution(txns: DataFrame, start: datetime | str) -> DataFrame:
    """Requests (not redactions) that contained each known PII type."""
    kind = txns.schema["pii_types"].dataType.typeName()
    types = F.col("pii_types") if kind == "array" else F.split("pii_types", ",")
    counts = since(txns, start).select(F.explode(types).alias("pii_type")).groupBy("pii_type").agg(
        F.count("*").alias("n"))
    return complete(counts, PII_TYPES, "pii_type", {"n": 0})


def status_tally(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n"))


def forwarded_calls(txns: DataFrame) -> DataFrame:
    """Calls that reached a model; blocked, throttled and rejected requests add nothing."""
    return txns.groupBy("target_model").agg(_when(F.col("status").isin("allowed", "error")).alias("calls"))


def tokens_by_key(txns: DataFrame) -> DataFrame:
    return txns.groupBy("masked_api_key").agg(F.count("*").alias("requests"), F.sum("total_tokens").alias("total_tokens"))
