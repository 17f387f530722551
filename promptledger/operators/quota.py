"""Token budgets over an exact sliding window.

Whether a request is admitted depends on which earlier ones were, so this is no window sum; but it need not be
one long fold either. Time is cut into slices as wide as the window. Where a key asks for no more than its limit in
a slice and the one before, every request of the slice is admitted, whatever happened earlier: the window at its end
is known without folding. A slice without requests leaves an empty window. Behind each such slice a new run
starts, opened by the slice's own requests. Runs are folded independently, each in order, with the live window as
the only memory: one plan, no loop, no job of its own.

A key that stays under its limit is as many runs as it has slices. One that asks for too much all the time is one
run: its decisions depend on each other without end, and one task streams through its narrow rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..schemas import DEFAULT_LIMIT, DEFAULT_WINDOW_S, QUOTA_TYPE
from .keys import authenticate

QUOTA_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in QUOTA_TYPE.fields)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a UTC timestamp with or without time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def effective_limit(limit: Column | None, default_limit: int) -> Column:
    """The key's limit; null and 0 mean the default."""
    d = F.lit(default_limit)
    return d if limit is None else F.coalesce(F.when(limit != 0, limit), d).cast("int")


def effective_cost(cost: Column) -> Column:
    """Whole tokens, never negative."""
    return F.greatest(F.lit(0).cast("long"), F.when(cost < 0, F.ceil(cost)).otherwise(F.floor(cost)).cast("long"))


class LiveWindow:
    """Admitted requests of one key that still count, oldest first."""

    __slots__ = ("width", "entries", "used")

    def __init__(self, width_us: int, entries=()):
        self.width = width_us
        self.entries = deque((int(us), int(cost)) for us, cost in entries)
        self.used = sum(cost for _, cost in self.entries)

    def expire(self, now: int) -> None:
        live = self.entries
        while live and live[0][0] <= now - self.width:
            self.used -= live.popleft()[1]

    def offer(self, now: int, cost: int, limit: int) -> tuple:
        """Admit or reject one request and report the quota fields."""
        self.expire(now)
        live, wait = self.entries, 0
        ok = self.used + cost <= limit
        if ok:
            live.append((now, cost))
            self.used += cost
        else:
            wait = self._wait(now, cost, limit)
        reset = max(0, live[0][0] + self.width - now) if live else 0
        return (ok, limit, self.used, max(0, limit - self.used), len(live), self.width // 1_000_000,
                reset / 1e6, -(-wait // 1_000_000))

    def _wait(self, now: int, cost: int, limit: int) -> int:
        # Entries leave oldest first; wait for the one whose exit makes enough room.
        short = self.used + cost - limit
        if cost <= limit:
            for us, c in self.entries:
                short -= c
                if short <= 0:
                    return max(0, us + self.width - now)
        return self.width


def _fold(width: int):
    """Decides the rows of each (key, run) in order; opening rows only fill the window."""
    names = [f.name for f in QUOTA_TYPE.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, window = None, LiveWindow(width)
        for pdf in batches:
            out, real = [], []
            rows = zip(pdf["k"], pdf["run"], pdf["us"].tolist(), pdf["cost"].tolist(), pdf["lim"].tolist(), pdf["opens"].tolist())
            for i, (k, number, us, cost, lim, opens) in enumerate(rows):
                if at != (k, number):
                    at, window = (k, number), LiveWindow(width)
                if opens:
                    window.entries.append((us, cost))
                    window.used += cost
                else:
                    out.append(window.offer(us, cost, lim))
                    real.append(i)
            hits = pdf.iloc[real].reset_index(drop=True)
            yield pd.concat([hits[["k", "us", "ord", "cost"]], pd.DataFrame(out, columns=names)], axis=1)

    return run


def _runs(hits: DataFrame) -> DataFrame:
    """Per key and slice: its `run`, and `next_run` where its requests open the run behind it.

    One row per key and slice, from sums made in the map tasks.
    """
    w = Window.partitionBy("k").orderBy("slice")
    adjacent = F.coalesce(F.lag("slice").over(w) == F.col("slice") - 1, F.lit(False))
    sums = hits.groupBy("k", "slice").agg(F.sum("cost").alias("asked"), F.min("lim").alias("least"))
    sums = sums.select("k", "slice", adjacent.alias("adjacent"), (F.col("asked") + F.when(adjacent, F.lag("asked").over(w)).otherwise(0)
                                                                   <= F.col("least")).alias("calm"))
    cut = ~F.col("adjacent") | F.lag("calm").over(w)
    runs = sums.select("*", F.sum(F.coalesce(cut, F.lit(True)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    opens = F.col("calm") & F.coalesce(F.lead("slice").over(w) == F.col("slice") + 1, F.lit(False))
    return runs.select("k", "slice", "run", F.when(opens, F.col("run") + 1).alias("next_run"))


def admissions(df: DataFrame, key: str, ts: str, order: str, cost: str, limit: str | None = None, *,
               default_limit: int = DEFAULT_LIMIT, window_s: int = DEFAULT_WINDOW_S,
               partitions: int | None = None) -> DataFrame:
    """Decide every request of a log: `key`, `ts`, `order`, `cost` and the struct `quota`, one row each.

    `order` is a unique integer; requests of a key are taken by (ts, order). Rows without a key are left
    out. Lazy; the rows are read twice, once for the sums per slice, so pass a table rather than a long plan.
    `partitions` sets the number of folding tasks.
    """
    width = window_s * 1_000_000
    hits = df.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("k"), micros(F.col(ts)).alias("us"), F.col(order).cast("long").alias("ord"),
        effective_cost(F.col(cost)).alias("cost"),
        effective_limit(F.col(limit) if limit else None, default_limit).alias("lim"))
    hits = hits.withColumn("slice", ((F.col("us") - F.pmod("us", F.lit(width))) / width).cast("long"))
    turns = F.array_compact(F.array(
        F.struct(F.col("run"), F.lit(False).alias("opens")),
        F.when(F.col("next_run").isNotNull(), F.struct(F.col("next_run").alias("run"), F.lit(True).alias("opens")))))
    rows = hits.join(_runs(hits), ["k", "slice"]).select("k", "us", "ord", "cost", "lim", F.inline(turns))
    rows = rows.repartition(partitions, "k", "run") if partitions else rows.repartition("k", "run")
    out = rows.sortWithinPartitions("k", "run", "us", "ord").mapInPandas(
        _fold(width), f"k string, us bigint, ord bigint, cost bigint, {QUOTA_DDL}")
    fields = [f.name for f in QUOTA_TYPE.fields]
    return out.select(
        F.col("k").cast(df.schema[key].dataType).alias(key),
        F.timestamp_micros("us").cast(df.schema[ts].dataType).alias(ts),
        F.col("ord").cast(df.schema[order].dataType).alias(order),
        F.col("cost").alias("cost"),
        F.struct(*[F.col(f) for f in fields]).alias("quota"))


def admit(df: DataFrame, key: str, ts: str, order: str, cost: str, limit: str | None = None, **options) -> DataFrame:
    """The frame with the struct `quota` added; null where `key` is null."""
    decided = admissions(df, key, ts, order, cost, limit, **options).select(order, "quota")
    return df.join(decided, order, "left")


def admitted_entries(decisions: DataFrame) -> DataFrame:
    """What a window remembers: the admitted requests only."""
    return decisions.filter("quota.allowed")


def quota_state(admitted: DataFrame, keys: DataFrame, as_of, *, key: str = "key", ts: str = "ts", cost: str = "cost",
                limit: str = "rate_limit", default_limit: int = DEFAULT_LIMIT, window_s: int = DEFAULT_WINDOW_S,
                resets: DataFrame | None = None) -> DataFrame:
    """State of every key at `as_of`, consuming nothing.

    `as_of` is a timestamp literal or datetime. `resets` holds (`key`, `reset_at`), a null key resetting
    all keys; entries up to a reset that lies at or before `as_of` are forgotten.
    """
    width = window_s * 1_000_000
    now = micros(F.lit(as_of).cast("timestamp_ntz"))
    us = micros(F.col(ts))
    live = admitted.filter((us > now - width) & (us <= now))
    if resets is not None:
        done = resets.filter(micros(F.col("reset_at")) <= now)
        per_key = done.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("reset_at").alias("_own"))
        for_all = done.filter(F.col(key).isNull()).agg(F.max("reset_at").alias("_all"))
        live = live.join(per_key, key, "left").withColumn("_all", for_all.scalar())
        last = F.greatest(F.col("_own"), F.col("_all"))
        live = live.filter(last.isNull() | (F.col(ts) > last)).drop("_own", "_all")
    sums = live.groupBy(key).agg(F.sum(cost).alias("_used"), F.count("*").alias("_n"), F.min(us).alias("_oldest"))
    lim = effective_limit(F.col(limit), default_limit)
    used = F.coalesce(F.col("_used"), F.lit(0)).cast("long")
    reset = F.coalesce(F.greatest(F.lit(0).cast("long"), F.col("_oldest") + width - now) / 1e6, F.lit(0.0))
    return keys.join(sums, key, "left").select(
        key, lim.alias("limit"), used.alias("used"), F.greatest(F.lit(0).cast("long"), lim - used).alias("remaining"),
        F.coalesce(F.col("_n"), F.lit(0)).cast("int").alias("request_count"), F.lit(window_s).alias("window_seconds"),
        reset.alias("reset_in_seconds"))


def key_status(asked: DataFrame, keys: DataFrame, admitted: DataFrame, as_of, secret: str, raw: str = "raw_key",
               **options) -> DataFrame:
    """The budget behind each asked raw key at `as_of`, consuming nothing.

    Rows: `masked_key`, `http_status` (200; 401 missing or invalid; 403 revoked), `auth_reason` and the struct
    `rate_limit`, null for a rejected key. `admitted` holds (`key_hash`, `ts`, `cost`).
    """
    known = authenticate(asked, keys, secret, raw)
    valid = known.filter(F.col("auth_reason").isNull()).select("key_hash", "key_limit").distinct()
    state = quota_state(admitted, valid, as_of, key="key_hash", limit="key_limit", **options)
    info = state.select("key_hash", quota_info(F.struct(*[c for c in state.columns if c != "key_hash"])).alias("rate_limit"))
    code = F.when(F.col("auth_reason").isNull(), 200).when(F.col("auth_reason") == "revoked", 403).otherwise(401)
    return known.join(info, "key_hash", "left").select("masked_key", code.alias("http_status"), "auth_reason", "rate_limit")


def quota_info(quota: Column) -> Column:
    """The part of a quota a caller sees; the reset time to 2 places."""
    return F.struct(*[quota[f].alias(f) for f in ("limit", "used", "remaining", "request_count", "window_seconds")],
                    F.round(quota["reset_in_seconds"], 2).alias("reset_in_seconds"))


def retry_after(quota: Column) -> Column:
    """Seconds a throttled caller is told to wait: at least one. Null when admitted."""
    return F.when(~quota["allowed"], F.greatest(F.lit(1), quota["retry_after_seconds"]))


def demand(df: DataFrame, key: str, ts: str, order: str, cost: str, window_s: int = DEFAULT_WINDOW_S) -> DataFrame:
    """Tokens requested in the window ending at each request, admitted or not: `key`, `ts`, `order`, `demand`.

    The frame runs per (key, time slice) with the slice before it copied in, so a busy key is spread over
    as many tasks as it has slices instead of being sorted by one.
    """
    width = window_s * 1_000_000
    base = df.select(key, ts, order, F.col(cost).alias("_cost"), micros(F.col(ts)).alias("_us"))
    home = ((F.col("_us") - F.pmod(F.col("_us"), F.lit(width))) / width).cast("long")
    sliced = base.select("*", home.alias("_home"), F.explode(F.array(home, home + 1)).alias("_slice"))
    w = Window.partitionBy(key, "_slice").orderBy("_us").rangeBetween(-(width - 1), 0)
    return (
        sliced.withColumn("demand", F.sum("_cost").over(w)).filter(F.col("_slice") == F.col("_home"))
        .select(key, ts, order, "demand")
    )
