"""Toxicity: a classifier chain of sparse linear models over hashed words and word starts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import rows_of, text_rows

DIMS = 1 << 18
STARTS = (4, 5)
#: The chain is fitted on at most so many labelled rows, the first by a hash of their ids.
MAX_LABELLED = 20_000
FOLDS = 3
#: A bucket enters a model from so many texts and standard errors on, up to a number of buckets.
MIN_TEXTS, MIN_Z, MAX_BUCKETS = 5, 4.5, 4096
LASSO, STEPS = 2e-4, 150
#: Places of buckets that are worked on at a time where the model is fitted.
PLACES = 1 << 20
REJECT_FROM = 0.5

#: Runs of letters in lower-cased UTF-8; all other scripts' characters count as letters.
_WORD = re.compile(rb"[a-z\x80-\xff]+")

#: Categories in the order of the chain, as conditions on `labels`.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


def hashed(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and of its first bytes."""
    out = [zlib.crc32(word) % DIMS]
    for n in STARTS:
        if len(word) > n:
            out.append(zlib.crc32(word[:n], n) % DIMS)
    return tuple(out)


class Buckets:
    """The distinct buckets of a text; words seen lately are remembered."""

    def __init__(self, remember: int = 200_000):
        self.seen: dict[bytes, tuple[int, ...]] = {}
        self.remember = remember

    def __call__(self, text: str) -> np.ndarray:
        if len(self.seen) > self.remember:
            self.seen.clear()
        out: set[int] = set()
        for word in set(_WORD.findall(text.lower().encode("utf-8", "surrogatepass"))):
            if (b := self.seen.get(word)) is None:
                b = self.seen[word] = hashed(word)
            out.update(b)
        return np.sort(np.fromiter(out, np.int32, len(out)))


class Linear:
    """Logistic model over the presence of buckets and a few dense inputs."""

    def __init__(self, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.weights, self.dense, self.bias = weights, dense, bias

    def __call__(self, flat: np.ndarray, ends: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return _logistic(_row_sums(self.weights[flat], ends) + dense @ self.dense + self.bias)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def _row_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def _slices(flat: np.ndarray, ends: np.ndarray, places: int = PLACES) -> Iterator[tuple[slice, np.ndarray]]:
    """Runs of rows with about `places` places, and their part of `flat`: what is derived from it stays small."""
    at = 0
    while at < len(ends):
        start = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, start + places, "right")))
        yield slice(at, stop), flat[start:int(ends[stop - 1])]
        at = stop


class Limits(NamedTuple):
    """Which buckets enter a model: those of so many texts whose presence differs between the classes by so many
    standard errors, the clearest of them."""

    min_texts: int = MIN_TEXTS
    min_z: float = MIN_Z
    max_buckets: int = MAX_BUCKETS


def fit_linear(flat: np.ndarray, ends: np.ndarray, dense: np.ndarray, y: np.ndarray, limits: Limits = Limits()) -> Linear:
    """L1-regularised logistic regression by accelerated proximal gradient, on the buckets that `limits` lets in."""
    n, weights = len(ends), np.zeros(DIMS)
    if not n or y.min() == y.max():
        rate = (y.sum() + 0.5) / (n + 1.0)
        return Linear(weights, np.zeros(dense.shape[1]), float(np.log(rate / (1 - rate))))
    # A bucket counts once per text, so its number of places is its number of texts.
    texts, good = np.zeros(DIMS, np.int64), np.zeros(DIMS, np.int64)
    for rows, part in _slices(flat, ends):
        sizes = np.diff(ends[rows], prepend=ends[rows.start - 1] if rows.start else 0)
        texts += np.bincount(part, minlength=DIMS)
        good += np.bincount(part[np.repeat(y[rows] > 0, sizes)], minlength=DIMS)
    ones, p = y.sum(), (texts + 0.5) / (n + 1.0)
    z = np.abs(good / ones - (texts - good) / (n - ones)) / np.sqrt(p * (1 - p) * (1 / ones + 1 / (n - ones)))
    used = np.flatnonzero((texts >= limits.min_texts) & (z >= limits.min_z))
    used = np.sort(used[np.argsort(-z[used], kind="stable")[:limits.max_buckets]])
    k = len(used)
    place = np.full(DIMS, -1, np.int32)
    place[used] = np.arange(k, dtype=np.int32)
    rows, cols, at = np.empty(int(texts[used].sum()), np.int32), np.empty(int(texts[used].sum()), np.int32), 0
    for those, part in _slices(flat, ends):
        sizes = np.diff(ends[those], prepend=ends[those.start - 1] if those.start else 0)
        held = place[part]
        kept = held >= 0
        end = at + int(kept.sum())
        rows[at:end], cols[at:end] = np.repeat(np.arange(those.start, those.stop, dtype=np.int32), sizes)[kept], held[kept]
        at = end
    dense = np.hstack([dense, np.ones((n, 1))])

    # The same sums in the same order, a part of the places at a time.
    parts = [slice(i, i + PLACES) for i in range(0, len(rows), PLACES)]

    def forward(x):
        out = np.zeros(n)
        for i in parts:
            np.add.at(out, rows[i], x[cols[i]])
        return out + dense @ x[k:]

    def backward(v):
        out = np.zeros(k)
        for i in parts:
            np.add.at(out, cols[i], v[rows[i]])
        return np.concatenate([out, dense.T @ v])

    v = np.ones(k + dense.shape[1])
    for _ in range(15):  # the largest curvature, by power iteration
        v = backward(forward(v / np.linalg.norm(v))) / n
    step = 3.6 / np.linalg.norm(v)
    x = np.zeros(k + dense.shape[1])
    look, t = x, 1.0
    for _ in range(STEPS):
        new = look - step * backward(_logistic(forward(look)) - y) / n
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * LASSO, 0.0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look, x = new + (before - 1) / t * (new - x), new
    weights[used] = x[:k]
    return Linear(weights, x[k:-1], float(x[-1]))


class Chain:
    """Categories in order; each model also sees the probabilities of those before it."""

    def __init__(self, models: list[Linear]):
        self.models = models

    def __call__(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        seen = np.zeros((len(ends), 0))
        for m in self.models:
            seen = np.hstack([seen, m(flat, ends, seen)[:, None]])
        return seen


def _packed(lists) -> tuple[np.ndarray, np.ndarray]:
    lists = list(lists)
    return (np.concatenate(lists) if lists else np.zeros(0, np.int32)), np.cumsum([len(x) for x in lists], dtype=np.int64)


def fit_chain(buckets: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, limits: Limits = Limits()) -> Chain:
    """Models of all categories (columns of `labels`) in order; a row without a label (NaN) is left out of that model.

    What a later model is trained on as the probability of an earlier category comes from a model that has not
    seen the row: one per fold. Scoring uses the models fitted on all rows.
    """
    seen, models = np.zeros((len(buckets), 0)), []

    def fitted(rows: np.ndarray, y: np.ndarray) -> Linear:
        rows = rows[~np.isnan(y[rows])]
        return fit_linear(*_packed(buckets[i] for i in rows), seen[rows], y[rows], limits)

    for c in range(labels.shape[1]):
        y = labels[:, c]
        models.append(fitted(np.arange(len(buckets)), y))
        if c + 1 == labels.shape[1]:
            break
        out = np.zeros(len(buckets))
        for f in np.unique(folds):
            mine, rest = np.flatnonzero(folds == f), np.flatnonzero(folds != f)
            out[mine] = fitted(rest, y)(*_packed(buckets[i] for i in mine), seen[mine])
        seen = np.hstack([seen, out[:, None]])
    return Chain(models)


def train(docs: DataFrame, labels: DataFrame, *, categories=CATEGORIES, max_labelled: int = MAX_LABELLED, limits: Limits = Limits()) -> Chain:
    """The chain, fitted on at most `max_labelled` labelled texts; contradicting labels count as positive.

    A text under an id counts once, however often the row is repeated, and different texts under one id are texts
    of their own; those of the smallest hashes stay. They are hashed into buckets where they lie; their buckets, of
    bounded number, come to the driver. A null label leaves a text out of that category's model only.
    """
    flags = [F.max(F.expr(cond).cast("int")).alias(f"c{i}") for i, (_, cond) in enumerate(categories)]
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*flags).dropna("all", subset=[f"c{i}" for i in range(len(flags))])
    # At most `max_labelled` ids.
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = text_rows(docs).join(F.broadcast(known), "doc_id").select(
        F.xxhash64("doc_id", "text").alias("h"), F.array(*[f"c{i}" for i in range(len(categories))]).alias("y"), "text")
    # At most `max_labelled` hashes.
    taken = rows.select("h").distinct().orderBy("h").limit(max_labelled)

    def run(batches):
        of = Buckets()
        for hs, ys, texts in rows_of(batches, "h", "y", "text"):
            yield pa.RecordBatch.from_arrays(
                [pa.array(hs, pa.int64()), pa.array(ys, pa.list_(pa.int32())), pa.array([of(t) for t in texts], pa.list_(pa.int32()))],
                names=["h", "y", "b"])

    hashed_rows = rows.join(F.broadcast(taken), "h", "left_semi").select("h", "y", "text").mapInArrow(run, "h bigint, y array<int>, b array<int>")
    found = hashed_rows.groupBy("h").agg(F.first("y").alias("y"), F.first("b").alias("b")).toArrow()
    # In the order of the hashes; the buckets stay where they were received.
    h = found["h"].to_numpy()
    order = np.argsort(h, kind="stable")
    buckets = [flat[start:end] for c in found["b"].chunks for flat, offsets in [(c.values.to_numpy(), c.offsets.to_numpy().tolist())]
               for start, end in zip(offsets, offsets[1:])]
    h, buckets = h[order], [buckets[i] for i in order.tolist()]
    y = np.array([[np.nan if v is None else v for v in r] for r in found["y"].to_pylist()], float).reshape(len(h), len(categories))[order]
    return fit_chain(buckets, y, np.abs(h) % FOLDS, limits)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Each row of `docs` as the struct `row`, and the array `p` of category probabilities in the order of the chain."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    @F.pandas_udf("array<double>")
    def chained(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Buckets()
        for texts in batches:
            yield pd.Series(list(chain(*_packed(of(t) for t in texts))), dtype=object)

    return rows.select("row", chained("text").alias("p"))


def classify(docs: DataFrame, labels: DataFrame, *, reject_from: float = REJECT_FROM, categories=CATEGORIES,
             max_labelled: int = MAX_LABELLED, limits: Limits = Limits()) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `p_<category>` of each category, and `rejected`, by the last category.

    A null or empty text has no buckets and gets the models' base rates. Without labels every probability is
    0.5 and nothing is rejected. Repeated rows and null ids are judged row by row; an empty table gives an
    empty result. Whole texts are read; a bucket counts by presence, so length alone moves no score.
    """
    chain = train(docs, labels, categories=categories, max_labelled=max_labelled, limits=limits)
    ps = [F.get("p", F.lit(i)).alias(f"p_{name}") for i, (name, _) in enumerate(categories)]
    rejected = F.get("p", F.lit(len(categories) - 1)) > reject_from
    return score(docs.select("doc_id", "text"), chain).select("row.doc_id", *ps, rejected.alias("rejected"))


def clean(docs: DataFrame, labels: DataFrame, *, reject_from: float = REJECT_FROM, **options) -> DataFrame:
    """The rows of `docs` that `classify` does not reject, with all their columns, whatever their names."""
    kept = score(docs, train(docs, labels, **options)).where(F.element_at("p", -1) <= reject_from)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
