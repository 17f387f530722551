"""Budgets on streams in the order of request time: late rows aside, state that opens from a batch and leaves when idle.

`admission.admit_stream` decides a request when it arrives. Here a request waits until the watermark has passed its
time; then nothing earlier can come, so decisions are those of one fold over the whole log, however its rows were
shuffled within the allowed lateness. What comes later than that is not decided but told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.quota import QUOTA_DDL, LiveWindow, effective_cost, effective_limit, micros, quota_state
from ..schemas import DEFAULT_LIMIT, DEFAULT_WINDOW_S, QUOTA_TYPE
from .admission import _JSON, BUCKETS, UNCHARGED_SLOTS, bucket

_FIELDS = [f.name for f in QUOTA_TYPE.fields]
_HIT, _RESET, _PASS = 0, 1, 2
_LIVE = "k string, us bigint, cost bigint"
_PENDING = "k string, us bigint, ord bigint, cost bigint, lim int, kind int, payload string"
_OUT = f"k string, us bigint, ord bigint, payload string, late boolean, {QUOTA_DDL}"


class _Ordered(StatefulProcessor):
    """Per bucket of keys: the live window of each key, and the requests whose time the watermark has not passed.

    One timer stands at the earliest of these, or where a window will be empty: a key without requests leaves the
    state by itself. A call costs more than the few rows that most keys have, so keys share one by their hash.
    """

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", _LIVE)
        self.pending = handle.getListState("pending", _PENDING)

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        entries = sorted(zip(initialState["k"].tolist(), initialState["us"].tolist(), initialState["cost"].tolist()))
        if entries:
            self.live.appendList(entries)
            self._wake(min({k: us for k, us, _ in entries}.values()) + self.width)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        first, freed = None, {}
        for pdf in rows:
            late = pdf["us"] < passed
            at_once = pdf[(pdf["kind"] == _PASS) | (late & (pdf["kind"] == _HIT))]
            if len(at_once):
                yield _told(at_once, [(None,) * len(_FIELDS)] * len(at_once), (late & (pdf["kind"] == _HIT))[at_once.index])
            resets = pdf[late & (pdf["kind"] == _RESET)]
            for k, us in zip(resets["k"].tolist(), resets["us"].tolist()):
                freed[k] = max(us, freed.get(k, us))
            wait = pdf[~late & (pdf["kind"] != _PASS)]
            if len(wait):
                columns = [wait[c.split()[0]] for c in _PENDING.split(", ")]
                self.pending.appendList([tuple(r) for r in zip(*(c.tolist() for c in columns))])
                first = int(wait["us"].min()) if first is None else min(first, int(wait["us"].min()))
        if freed:
            # A late reset frees what it can and revises no decision.
            self._keep([e for e in self._held() if e[0] not in freed or e[1] > freed[e[0]]])
        if first is not None:
            self._wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.pending.get()) if self.pending.exists() else []
        # At one time a reset comes after the requests.
        due = sorted((p for p in waiting if p[1] < passed), key=lambda p: (p[1], p[5], p[2]))
        rest = [p for p in waiting if p[1] >= passed]
        held: dict[str, list] = {}
        for k, us, cost in self._held():
            held.setdefault(k, []).append((us, cost))
        windows = {k: LiveWindow(self.width, sorted(entries, key=lambda e: e[0])) for k, entries in held.items()}
        told, quota = [], []
        for p in due:
            k, us, _, cost, lim, kind, _ = p
            if kind == _RESET or k not in windows:
                windows[k] = LiveWindow(self.width)
            if kind != _RESET:
                told.append(p)
                quota.append(windows[k].offer(us, cost, lim))
        for window in windows.values():
            window.expire(passed)
        if due:
            self.pending.put(rest) if rest else self.pending.clear()
        entries = [(k, us, cost) for k, window in windows.items() for us, cost in window.entries]
        if due or len(entries) < sum(map(len, held.values())):
            self._keep(entries)
        next_us = [p[1] for p in rest] + [w.entries[-1][0] + self.width for w in windows.values() if w.entries]
        if next_us:
            self._wake(min(next_us))
        if told:
            rows = pd.DataFrame(told, columns=[c.split()[0] for c in _PENDING.split(", ")])
            yield _told(rows, quota, pd.Series(False, rows.index))

    def _held(self) -> list[tuple]:
        return list(self.live.get()) if self.live.exists() else []

    def _keep(self, entries: list) -> None:
        if entries:
            self.live.put(entries)
        elif self.live.exists():
            self.live.clear()

    def close(self) -> None:
        pass


def _told(rows: pd.DataFrame, quota: list[tuple], late: pd.Series) -> pd.DataFrame:
    out = rows[["k", "us", "ord", "payload"]].reset_index(drop=True)
    out["late"] = late.to_numpy()
    return pd.concat([out, pd.DataFrame(quota, columns=_FIELDS, dtype=object)], axis=1)


def admit_in_order(stream: DataFrame, key: str, ts: str, order: str, cost: str, limit: str | None = None, *, lateness_s: int,
                   default_limit: int = DEFAULT_LIMIT, window_s: int = DEFAULT_WINDOW_S, resets: DataFrame | None = None,
                   all_keys: DataFrame | None = None, opening: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The stream with the struct `quota` and the flag `late` added; rows come out when they are decided.

    A request is decided once a request `lateness_s` later has been seen, in the order of (`ts`, `order`) among all of its
    key's. One that arrives behind that is passed on at once with `late` set and no quota, and costs nothing. Rows without
    a key are passed on at once and spread over slots; they move the clock, so they serve as heartbeats.

    `resets`, a stream of (`key`, `reset_at`), empties a key's window at that time, after the requests of the same time;
    with a null key all of `all_keys` (a table with the column `key`). They do not move the clock and may be given ahead. `opening` is a table of admitted requests
    (`key`, `ts`, `cost`), such as a batch audit left behind: the windows start with them.

    State: the admitted requests of each key's last window and what waits for the watermark; both leave by timers. Keys
    share `buckets` lots of it by their hash, each read and written as a whole where one of its keys has rows; the number is
    kept for the life of a checkpoint. A key's waiting rows are sorted in one task. Needs the RocksDB state store (`use_rocksdb`).
    """
    rest = [c for c in stream.columns if c not in (ts, order, key)]
    name = F.col(key).cast("string")
    slot = F.concat(F.lit("-"), F.pmod(F.hash(order), F.lit(UNCHARGED_SLOTS)).cast("string"))
    # The clock column ends here: Spark would drop late rows by it, and here they are told apart.
    clocked = stream.withColumn("_clock", F.col(ts).cast("timestamp")).withWatermark("_clock", f"{lateness_s} seconds")
    packed = clocked.select(
        F.when(name.isNull(), slot).otherwise(bucket(name, buckets)).alias("slot"), name.alias("k"), F.unix_micros("_clock").alias("us"),
        F.col(order).cast("long").alias("ord"), effective_cost(F.col(cost)).alias("cost"),
        effective_limit(F.col(limit) if limit else None, default_limit).alias("lim"),
        F.when(name.isNull(), _PASS).otherwise(_HIT).alias("kind"), F.to_json(F.struct(*[F.col(c) for c in rest]), _JSON).alias("payload"))
    if resets is not None:
        own = resets.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), "reset_at")
        if all_keys is not None:
            # A row for each key: that is what such a reset does. The control rows of a micro-batch are few.
            whole = resets.where(F.col(key).isNull()).select(F.lit(1).alias("every"), "reset_at")
            own = own.unionByName(whole.join(all_keys.select(F.col(key).cast("string").alias("k"), F.lit(1).alias("every")), "every").select("k", "reset_at"))
        packed = packed.unionByName(own.select(
            bucket(F.col("k"), buckets).alias("slot"), "k", micros(F.col("reset_at")).alias("us"), F.lit(0).cast("long").alias("ord"),
            F.lit(0).cast("long").alias("cost"), F.lit(0).alias("lim"), F.lit(_RESET).alias("kind"), F.lit(None).cast("string").alias("payload")))
    start = None
    if opening is not None:
        start = opening.where(F.col(key).isNotNull()).select(
            bucket(F.col(key).cast("string"), buckets).alias("slot"), F.col(key).cast("string").alias("k"), micros(F.col(ts)).alias("us"),
            effective_cost(F.col(cost)).alias("cost")).groupBy("slot")
    decided = packed.groupBy("slot").transformWithStateInPandas(
        _Ordered(window_s * 1_000_000), outputStructType=_OUT, outputMode="Append", timeMode="EventTime", initialState=start)
    shape = stream.select(*rest).schema
    kinds = {c: stream.schema[c].dataType for c in (key, ts, order)}
    back = decided.withColumn("_rest", F.from_json("payload", shape, _JSON))
    return back.select(
        F.col("k").cast(kinds[key]).alias(key),
        F.timestamp_micros("us").cast(kinds[ts]).alias(ts), F.col("ord").cast(kinds[order]).alias(order), "_rest.*", "late",
        F.when(F.col("allowed").isNotNull(), F.struct(*[F.col(f) for f in _FIELDS])).alias("quota"))


def live_entries(spark: SparkSession, checkpoint: str, key_type: str = "string") -> DataFrame:
    """What the windows of a stream hold after its last micro-batch: `key`, `ts`, `cost`. The stream may be running."""
    rows = spark.read.format("statestore").option("stateVarName", "live").load(checkpoint)
    entry = F.col("list_element")
    return rows.select(entry["k"].cast(key_type).alias("key"),
                       F.timestamp_micros(entry["us"]).cast("timestamp_ntz").alias("ts"), entry["cost"].alias("cost"))


def waiting(spark: SparkSession, checkpoint: str, key_type: str = "string") -> DataFrame:
    """Requests and resets that the watermark has not passed: `key`, `ts`, `order`, `cost`, `reset`."""
    rows = spark.read.format("statestore").option("stateVarName", "pending").load(checkpoint)
    entry = F.col("list_element")
    return rows.select(entry["k"].cast(key_type).alias("key"),
                       F.timestamp_micros(entry["us"]).cast("timestamp_ntz").alias("ts"), entry["ord"].alias("order"),
                       entry["cost"].alias("cost"), (entry["kind"] == _RESET).alias("reset"))


def peek(spark: SparkSession, checkpoint: str, keys: DataFrame, as_of, **options) -> DataFrame:
    """The budget of every key of `keys` (`key`, `rate_limit`) at `as_of`, from a stream's state, consuming nothing.

    Exact for times from the watermark on, as far as requests are decided. `options` are those of `quota_state`.
    """
    held = live_entries(spark, checkpoint, keys.schema["key"].dataType.simpleString())
    return quota_state(held, keys, as_of, **options)
