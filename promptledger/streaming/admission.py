"""Sliding-window admission with keyed state that survives restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.quota import QUOTA_DDL, LiveWindow, effective_cost, effective_limit, micros
from ..schemas import DEFAULT_LIMIT, DEFAULT_WINDOW_S, QUOTA_TYPE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UNCHARGED_SLOTS = 256
#: Lots of keys that are decided in one call each.
BUCKETS = 1024
#: Times keep their microseconds on the way through the state step.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "true"}
_FIELDS = [f.name for f in QUOTA_TYPE.fields]


def bucket(key: Column, buckets: int) -> Column:
    """The lot that a key (as text) is decided in."""
    return F.concat(F.lit("b"), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string"))


class _Admission(StatefulProcessor):
    """State per key: the live window. It is cleared once nothing in it counts any more.

    A call costs more than the few rows that most keys have, so keys share one by their hash; of the state only the windows
    of keys with rows are read and written.
    """

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "k string", "entries array<struct<us: bigint, cost: bigint>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # One bucket's part of one micro-batch; the source's rate limit bounds it.
        batch = pd.concat(list(rows)).sort_values(["us", "ord"], kind="stable")
        if not batch["charge"].iloc[0]:
            quota = pd.DataFrame([[None] * len(_FIELDS)] * len(batch), columns=_FIELDS)
        else:
            windows: dict[str, LiveWindow] = {}
            before: dict[str, tuple | None] = {}
            told = []
            for k, us, cost, lim in zip(batch["k"].tolist(), batch["us"].tolist(), batch["cost"].tolist(), batch["lim"].tolist()):
                if (window := windows.get(k)) is None:
                    before[k] = self.live.getValue((k,))
                    window = windows[k] = LiveWindow(self.width, before[k][0] if before[k] else ())
                told.append(window.offer(us, cost, lim))
            quota = pd.DataFrame(told, columns=_FIELDS)
            for k, window in windows.items():
                if window.entries:
                    self.live.updateValue((k,), (list(window.entries),))
                elif before[k]:
                    self.live.removeKey((k,))
        yield pd.concat([batch[["k", "us", "ord", "cost", "payload"]].reset_index(drop=True), quota], axis=1)

    def close(self) -> None:
        pass


def admit_stream(stream: DataFrame, key: str, ts: str, order: str, cost: str, limit: str | None = None, *,
                 charge: str | None = None, default_limit: int = DEFAULT_LIMIT, window_s: int = DEFAULT_WINDOW_S,
                 buckets: int = BUCKETS) -> DataFrame:
    """The stream with the struct `quota` added.

    A key's requests are taken by (ts, order) within a micro-batch and in order of arrival between them; a
    late request is decided when it comes and revises nothing. Where the boolean `charge` is false the
    quota is null and no budget is touched; such rows are spread over slots instead of sharing a key.
    Keys share `buckets` calls by their hash; the number is kept for the life of a checkpoint. Needs the RocksDB state
    store (`use_rocksdb`).
    """
    charged = F.col(charge) if charge else F.col(key).isNotNull()
    slot = F.concat(F.lit("-"), F.pmod(F.hash(order), F.lit(UNCHARGED_SLOTS)).cast("string"))
    rest = [c for c in stream.columns if c not in (ts, order, key)]
    packed = stream.select(
        F.when(charged, bucket(F.col(key).cast("string"), buckets)).otherwise(slot).alias("slot"), F.col(key).cast("string").alias("k"),
        micros(F.col(ts)).alias("us"), F.col(order).cast("long").alias("ord"),
        effective_cost(F.col(cost)).alias("cost"),
        effective_limit(F.col(limit) if limit else None, default_limit).alias("lim"), charged.alias("charge"),
        F.to_json(F.struct(*[F.col(c) for c in rest]), _JSON).alias("payload"))
    decided = packed.groupBy("slot").transformWithStateInPandas(
        _Admission(window_s * 1_000_000),
        outputStructType=f"k string, us bigint, ord bigint, cost bigint, payload string, {QUOTA_DDL}",
        outputMode="Append", timeMode="None")
    shape = stream.select(*rest).schema
    kinds = {c: stream.schema[c].dataType for c in (key, ts, order)}
    back = decided.withColumn("_rest", F.from_json("payload", shape, _JSON))
    return back.select(
        F.col("k").cast(kinds[key]).alias(key), F.timestamp_micros("us").cast(kinds[ts]).alias(ts),
        F.col("ord").cast(kinds[order]).alias(order), "_rest.*",
        F.when(F.col("allowed").isNotNull(), F.struct(*[F.col(f) for f in _FIELDS])).alias("quota"))


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
