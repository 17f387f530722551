"""Approximate nearest neighbours by collision counting: one sorted array per projection, query-centred windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

PROJECTIONS = 128
#: A vector is verified once it lies in the query's window of so many projections.
COLLISIONS = 64
#: Windows stop growing when so many vectors of a chunk, and this share of it, are to be verified.
CANDIDATES, SHARE = 512, 0.12
#: Share of a chunk in the first windows, and how they widen.
FIRST, GROWTH = 0.2, 1.15
CHUNK_ROWS, QUERY_ROWS = 8192, 2048
SEED = 7


def directions(dim: int, projections: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, projections))


class Index:
    """Sorted projections of the vectors of a chunk."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        self.lines = directions(vectors.shape[1])
        # Copies of a vector collide alike: only different vectors are indexed.
        self.different, self.of = np.unique(vectors, axis=0, return_inverse=True)
        self.of = self.of.ravel()
        on = self.different @ self.lines
        self.order = np.argsort(on.T, axis=1, kind="stable").astype(np.int32).ravel()
        # One array for all projections: each lies in a stretch of values of its own.
        self.gap = 4.0 * float(np.abs(on).max()) + 1.0
        self.shift = np.arange(on.shape[1]) * self.gap
        self.sorted = (np.sort(on.T, axis=1) + self.shift[:, None]).ravel()
        self.members = np.argsort(self.of, kind="stable")
        self.starts = np.searchsorted(self.of[self.members], np.arange(len(self.different) + 1))

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Different vectors that collide often enough once enough of them do.

        All windows are centred on the query and grow together; a larger window only adds the ranks at its two
        ends, so counts are carried from one size to the next.
        """
        n, m = len(self.different), self.lines.shape[1]
        need = min(n, max(CANDIDATES, k + 1, int(SHARE * n)))
        at = np.clip(query @ self.lines, -self.gap / 3, self.gap / 3) + self.shift
        first, last = np.arange(m) * n, np.arange(1, m + 1) * n
        low = high = np.searchsorted(self.sorted, at)
        counts = np.zeros(n, np.int64)
        span = int(FIRST * n) // 2 + 1
        width = float(np.median(self.sorted[np.minimum(high + span, last - 1)] - self.sorted[np.maximum(low - span, first)])) / 2
        width = max(width, 1e-9)
        while True:
            reach = min(width, self.gap / 2)
            a = np.minimum(low, np.maximum(first, np.searchsorted(self.sorted, at - reach)))
            b = np.maximum(high, np.minimum(last, np.searchsorted(self.sorted, at + reach, side="right")))
            counts += np.bincount(self.order[_ranges(np.concatenate([a, high]), np.concatenate([low, b]))], minlength=n)
            low, high = a, b
            found = np.flatnonzero(counts >= COLLISIONS)
            if len(found) >= need or bool((low == first).all() and (high == last).all()):
                return found
            width *= GROWTH

    def nearest(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, float]]:
        """The k nearest rows among the verified, nearest first, ties to smaller ids; never `own`."""
        found = self.candidates(query, k)
        away = np.sqrt(((self.different[found] - query) ** 2).sum(axis=1))
        order = np.lexsort((found, away))
        rows, score = [], []
        for i in order:
            ids = self.ids[self.members[self.starts[found[i]]:self.starts[found[i] + 1]]]
            ids = ids[ids != own]
            # Of many copies at one distance only the k smallest ids can be among the k nearest.
            ids = np.sort(ids)[:k] if len(ids) > k else ids
            rows.append(ids)
            score.append(np.full(len(ids), away[i]))
            if sum(map(len, rows)) >= k and (i == order[-1] or away[i] < away[order[-1]]) and _settled(away[order], away[i], rows, k):
                break
        ids, away = np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(score) if score else np.zeros(0)
        best = np.lexsort((ids, away))[:k]
        return list(zip(ids[best].tolist(), away[best].tolist()))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges [start, end), one after the other."""
    n = ends - starts
    return np.repeat(ends - np.cumsum(n), n) + np.arange(int(n.sum()))


def _settled(ordered: np.ndarray, now: float, rows: list, k: int) -> bool:
    """No further vector lies at the distance reached."""
    return int((ordered <= now).sum()) <= len(rows)


def usable(vectors: DataFrame) -> DataFrame:
    """`vec_id` and `v` (doubles) of vectors that are neither null, empty nor zero and hold only finite numbers."""
    v = F.col("embedding").cast("array<double>")
    inf = float("inf")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (x == inf) | (x == -inf))
    # A null in the array must not turn the test into a null.
    return vectors.select("vec_id", v.alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0").where(
        ~F.coalesce(F.exists("v", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == inf), F.lit(True))), F.lit(True))
        & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, *, chunk_rows: int = CHUNK_ROWS,
           query_rows: int = QUERY_ROWS) -> DataFrame:
    """The `k` nearest found of every query: `query_id`, `rank` from 1, `vec_id`, `score` (Euclidean, in doubles).

    Both frames hold `vec_id`, `embedding`. Vectors that are null, empty, zero or hold nulls or non-finite numbers
    take no part; only vectors of a query's own dimension are candidates, and none with its own id. A query given
    twice is answered once. With fewer candidates than `k` all are returned; ties go to smaller ids; an empty
    table gives an empty result.

    Rows are dealt by hash to chunks of about `chunk_rows`, queries to blocks of `query_rows`; every chunk is
    indexed once for each block and answers it, then the `k` best of all chunks are kept. The number of windows
    a chunk grows does not depend on the other chunks, so a task's memory is bounded and lost ones are redone alone.
    """
    base = usable(vectors).withColumn("dim", F.size("v"))
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    chunks = base.agg(F.greatest(F.ceil(F.count("*") / chunk_rows), F.lit(1))).scalar()
    blocks = asked.agg(F.greatest(F.ceil(F.count("*") / query_rows), F.lit(1))).scalar()

    def part(n):
        return F.pmod(F.xxhash64("vec_id", F.lit(SEED)), n).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))

    left = base.select("vec_id", "v", "dim", part(chunks).alias("chunk"), every(blocks).alias("block"))
    right = asked.select("vec_id", "v", "dim", part(blocks).alias("block"), every(chunks).alias("chunk"))
    cell = ["dim", "chunk", "block"]

    def answer(rows: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(questions):
            index = Index(np.stack(rows["v"].to_numpy()), rows["vec_id"].to_numpy())
            for q, v in zip(questions["vec_id"], questions["v"]):
                out += [(q, i, d) for i, d in index.nearest(np.asarray(v), q, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(
        answer, "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
