"""Best-fit packing of texts into bins of a fixed capacity, with conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import SPACE

CAPACITY = 4096
SHARD_ROWS = 8192
PER_SOURCE = 4


def best_fit(items: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item (size, source, cluster), largest first.

    Open bins are ordered by what is left in them. An item looks from the first bin with room for it upwards
    until one neither holds its cluster nor `per_source` items of its source: the tightest compatible bin. A bin
    carries its clusters and, in one plane for each further item, its sources as bitmaps. Equal residuals are
    taken in order of opening. Bins with equal residual and bitmaps are passed over together, so copies of one
    text do not try each other's bins one by one.
    """
    often = {c for c, n in Counter(c for _, _, c in items).items() if n > 1}
    cluster_bit = {c: 1 << i for i, c in enumerate(sorted(often))}  # a cluster of one cannot conflict
    source_bit = {s: 1 << i for i, s in enumerate(sorted({s for _, s, _ in items}))}
    residuals: list[int] = []
    bins: dict[int, dict[tuple, list[int]]] = {}  # residual, bitmaps: the bins, first opened on top
    opened = 0
    out: list[tuple[int, int]] = [(-1, -1)] * len(items)
    for n in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        size, source, cluster = items[n]
        mine, bit = cluster_bit.get(cluster, 0), source_bit[source]
        found = None
        for left in residuals[bisect_left(residuals, size):]:
            fits = [(heap[0], held) for held, heap in bins[left].items() if not held[0] & mine and not held[-1] & bit]
            if fits:
                found = min(fits)
                break
        if found:
            b, held = found
            heappop(bins[left][held])
            if not bins[left][held]:
                del bins[left][held]
                if not bins[left]:
                    del bins[left]
                    residuals.pop(bisect_left(residuals, left))
        else:
            left, b, held = capacity, opened, (0,) * (1 + per_source)
            opened += 1
        out[n] = (b, capacity - left)
        if left > size:
            planes = list(held[1:])
            at = next(k for k, plane in enumerate(planes) if not plane & bit)
            planes[at] |= bit
            left -= size
            if left not in bins:
                insort(residuals, left)
            heappush(bins.setdefault(left, {}).setdefault((held[0] | mine, *planes), []), b)
    return out


_PLACED = "doc_id bigint, piece int, first_word bigint, n_words bigint, bin string, bin_offset bigint"


def pack(docs: DataFrame, *, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS,
         cluster: str | None = None, order: tuple[str, str] | None = None) -> DataFrame:
    """Where each text goes: `doc_id`, `piece`, `first_word`, `n_words`, `bin`, `bin_offset`.

    A text takes its words and one end mark. Texts longer than `capacity` are cut into full pieces, a bin each,
    and a rest. No bin holds two texts of a duplicate cluster or more than `per_source` of a source. `cluster`
    names the column of cluster ids, such as op2's `component_id`; without it, and where it is null, texts that are
    equal but for the case of letters are a cluster, and near copies are not. Every row is placed, whole: null and empty texts take one end mark, a null source
    is a source, repeated rows are copies of each other and go to different bins; an empty table gives an empty
    result. Pieces of a text keep their order in `piece`; the end mark belongs to the last. Columns are read only
    where a parameter names them, and `doc_id`, `source` and `text`.

    `order` names two columns, the file a row is in and its place there. Then each run of `shard_rows` rows of a
    file is packed by itself, and two columns say which, `bin_file` and `bin_run`: bins read by these follow the order of
    the rows, and with it the shares of a mixture written in order, to a run. A null file or place counts as one.

    Scale: otherwise rows are dealt one by one by hash, copies of one text too, to shards of about `shard_rows`.
    Shards are packed by themselves; only ids, sizes and hashes move. A shard wastes a few half-empty bins in thousands.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.xxhash64(F.lower(text))
    if cluster is not None:
        own = F.when(F.col(f"`{cluster}`").isNotNull(), F.xxhash64(F.col(f"`{cluster}`"))).otherwise(own)
    size = (F.regexp_count(text, F.lit(f"[^{SPACE[1:-1]}]+")) + 1).cast("long")
    file, place = (F.lit(""), F.monotonically_increasing_id()) if order is None else (
        F.coalesce(F.col(f"`{order[0]}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{order[1]}`").cast("long"), F.lit(0)))
    sized = docs.select("doc_id", F.coalesce(F.xxhash64(F.col("source").cast("string")), F.lit(0)).alias("source"),
                        own.alias("cluster"), size.alias("size"), file.alias("file"), place.alias("place"))
    if order is None:
        shards = docs.agg(F.greatest(F.ceil(F.count("*") / shard_rows), F.lit(1))).scalar()
        run_of = F.pmod(F.xxhash64("doc_id", "cluster", "place"), shards)
    else:
        run_of = F.floor(F.col("place") / shard_rows)
    by = ["doc_id", "size", "source", "cluster"] if order is None else ["place", "doc_id", "size", "source", "cluster"]

    def run(key, pdf):
        pdf = pdf.sort_values(by, kind="stable", na_position="first")
        ids, sizes = pdf["doc_id"].tolist(), pdf["size"].tolist()
        name = str(key[1]) if order is None else f"{key[0]}.{key[1]}"
        rest = [(size - 1) % capacity + 1 for size in sizes]
        placed = best_fit(list(zip(rest, pdf["source"].tolist(), pdf["cluster"].tolist())), capacity, per_source)
        out = []
        for i, (doc, size) in enumerate(zip(ids, sizes)):
            full = (size - rest[i]) // capacity
            out += [(doc, k, k * capacity, capacity, f"{name}-{i}-{k}", 0, *key) for k in range(full)]
            out.append((doc, full, full * capacity, rest[i] - 1, f"{name}-{placed[i][0]}", placed[i][1], *key))
        frame = pd.DataFrame(out, columns=["doc_id", "piece", "first_word", "n_words", "bin", "bin_offset", "bin_file", "bin_run"])
        return frame.astype({"doc_id": "Int64"})[names]

    schema = _PLACED if order is None else f"{_PLACED}, bin_file string, bin_run bigint"
    names = [c.split()[0] for c in schema.split(", ")]
    return sized.withColumn("run", run_of.cast("long")).groupBy("file", "run").applyInPandas(run, schema)
