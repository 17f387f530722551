"""Upstream answers, attempts and stage logs. The library never calls a model; it joins logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

REASON_CHARS = 160


def first_success(attempts: DataFrame) -> DataFrame:
    """Per request: the first attempt that worked, how many failed before it, and which.

    Attempts per request are as many as models are configured. `failed` requests list all attempts.
    """
    has = set(attempts.columns)
    text = F.col("text") if "text" in has else F.lit(None).cast("string")
    tokens = F.col("output_tokens") if "output_tokens" in has else F.lit(None).cast("int")
    error = F.left("error", F.lit(REASON_CHARS)) if "error" in has else F.lit(None).cast("string")
    won = F.struct(F.col("model"), text.alias("text"), tokens.alias("output_tokens"))
    ok = F.col("ok")
    grouped = attempts.groupBy("request_id").agg(
        F.min(F.when(ok, F.col("attempt"))).alias("won_at"),
        F.min(F.when(ok, F.struct(F.col("attempt"), won.alias("won")))).alias("_first"),
        F.min("attempt").alias("_opening"),
        F.array_sort(F.collect_list(F.when(~ok, F.struct("attempt", "model", error.alias("reason"))))).alias("_bad"))
    before = F.filter("_bad", lambda f: F.col("won_at").isNull() | (f["attempt"] < F.col("won_at")))
    return grouped.select(
        "request_id", F.col("_first.won.model").alias("model"), F.col("_first.won.text").alias("text"),
        F.col("_first.won.output_tokens").alias("output_tokens"), "won_at",
        F.col("won_at").isNull().alias("failed"),
        F.coalesce(F.col("won_at") > F.col("_opening"), F.lit(False)).alias("fallback"),
        F.transform(before, lambda f: F.struct(f["model"].alias("model"), f["reason"].alias("reason"))).alias("failures"))


def attach_responses(decided: DataFrame, response_log: DataFrame, key: str = "request_id") -> DataFrame:
    """Add the logged answer: `response`, `llm_latency_ms`, `output_tokens` and `upstream_failed`."""
    log = response_log.select(key, F.col("text").alias("response"), F.col("latency_ms").alias("llm_latency_ms"),
                              "output_tokens", F.col("error").isNotNull().alias("upstream_failed"))
    return decided.join(log, key, "left")


def stage_durations(log: DataFrame) -> DataFrame:
    """Milliseconds since the previous stage of the same transaction, 3 places; null for the first.

    A transaction has at most nine stages, so its group is bounded.
    """
    w = Window.partitionBy("transaction_id").orderBy("seq")
    gap = (_micros("ts") - F.lag(_micros("ts")).over(w)) / 1000.0
    return log.withColumn("duration_ms", F.round(gap, 3))


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))
