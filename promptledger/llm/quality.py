"""Quality classifier: random Fourier features over text statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed
from .common import rows_of, text_rows

N_STATS, N_WAVES = 14, 256
GAMMA, RIDGE, SEED = 0.05, 1e-3, 20240501
#: The model is fitted on at most so many labelled rows, the first by a hash of their ids.
MAX_LABELLED = 60_000
GROUPS, STEPS = 16, 500
PREDICT_FROM = 0.7


def statistics(text: str) -> np.ndarray:
    """Shares and logs of counts of one text; zeros for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    parts = raw.split()
    if not parts:
        return np.zeros(N_STATS)
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(raw) - int(n[0x80:0xC0].sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    letters = int(n[65:91].sum() + n[97:123].sum()) + 1

    def count(signs: bytes) -> int:
        return int(n[list(signs)].sum())

    w = len(parts)
    return np.array([
        math.log1p(chars), math.log1p(w), (chars - count(b" \t\n\x0b\f\r")) / w, len(set(parts)) / w,
        n[65:91].sum() / letters, n[48:58].sum() / chars, n[33] / w, n[124] / w, count(b"#*$%&<>") / w,
        count(b".,;:?") / w, 1 - len(set(lines)) / len(lines), math.log1p(len(lines)) / math.log1p(w),
        (chars - letters - count(b" \t\n\x0b\f\r")) / chars, math.log1p(max(map(len, parts))),
    ])


def text_statistics(docs: DataFrame) -> DataFrame:
    """`doc_id` and `stats` of every row of `docs`; neither language, source nor label enters."""
    def run(batches):
        for ids, texts in rows_of(batches, "doc_id", "text"):
            stats = [statistics(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(stats, pa.list_(pa.float64()))],
                                             names=["doc_id", "stats"])

    return text_rows(docs).mapInArrow(run, "doc_id bigint, stats array<double>")


class Kernel:
    """cos(W x + b) features: their products approximate exp(-gamma |x - y|^2) of standardised statistics."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, gamma: float = GAMMA, waves: int = N_WAVES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w = rng.normal(0.0, math.sqrt(2 * gamma), (waves, len(mean)))
        self.b = rng.uniform(0.0, 2 * math.pi, waves)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.sd, -8.0, 8.0)
        waves = np.cos(x @ self.w.T + self.b) * math.sqrt(2 / len(self.b))
        return np.hstack([waves, np.ones((len(x), 1))])


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence in weighted least squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist()):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


class Calibrator:
    """Isotonic map of raw scores to shares of good rows, joined by straight lines between its steps."""

    def __init__(self, places: np.ndarray, good: np.ndarray, n: np.ndarray):
        fitted = pool_adjacent((good + 0.5 * 1e-3) / (n + 1e-3), n)
        # One knot in the middle of each level keeps the order of scores inside it.
        cuts = np.flatnonzero(np.diff(fitted)) + 1
        at = np.array([np.average(p, weights=w) for p, w in zip(np.split(places, cuts), np.split(n, cuts))])
        level = fitted[np.concatenate([[0], cuts])]
        self.x = np.concatenate([[at[0] - 1.0], at, [at[-1] + 1.0]])
        self.y = np.clip(np.concatenate([[level[0] * 0.9], level, [level[-1] * 0.9 + 0.1]]), 0.0, 1.0)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    def __init__(self, kernel: Kernel, beta: np.ndarray, calibrate: Calibrator):
        self.kernel, self.beta, self.calibrate = kernel, beta, calibrate

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        return self.calibrate(self.kernel(stats) @ self.beta)


def fit(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """The model, or None without labelled rows. `labels` has `doc_id`, `quality`; contradictions count as bad.

    Sums over groups of rows give the moments, then the normal equations, then good and all rows per score step;
    each is of fixed size and added up in the order of the groups, so the model does not depend on scheduling.
    """
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg(F.min("quality").cast("double").alias("y"))
    # At most `max_labelled` ids; the rows they pick are narrow.
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    train = checkpointed(stats.join(known, "doc_id").groupBy("doc_id", "y").agg(F.min("stats").alias("stats")).withColumn(
        "g", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS))))

    def summed(of, width: int) -> np.ndarray | None:
        def run(key, pdf):
            pdf = pdf.sort_values("doc_id")
            return pd.DataFrame({"g": [key[0]], "s": [of(np.stack(pdf["stats"]), pdf["y"].to_numpy()).ravel()]})

        parts = train.groupBy("g").applyInPandas(run, "g bigint, s array<double>").orderBy("g").collect()
        return sum(np.asarray(r["s"]) for r in parts).reshape(-1, width) if parts else None

    moments = summed(lambda x, y: np.vstack([np.full(N_STATS, len(x)), x.sum(0), (x * x).sum(0)]), N_STATS)
    if moments is None:
        return None
    mean = moments[1] / moments[0]
    kernel = Kernel(mean, np.sqrt(np.maximum(moments[2] / moments[0] - mean**2, 0.0)))

    def normal(x, y):
        z = kernel(x)
        return np.vstack([z.T @ z, z.T @ y])

    sums = summed(normal, N_WAVES + 1)
    gram, right = sums[:-1], sums[-1]
    beta = np.linalg.solve(gram + RIDGE * moments[0, 0] * np.eye(len(gram)) / len(gram), right)

    def steps(x, y):
        at = np.clip(np.round((kernel(x) @ beta + 0.5) * STEPS / 2), 0, STEPS).astype(int)
        return np.stack([np.bincount(at, minlength=STEPS + 1), np.bincount(at, weights=y, minlength=STEPS + 1)], axis=1)

    hist = summed(steps, 2)
    used = np.flatnonzero(hist[:, 0])
    return Model(kernel, beta, Calibrator(used * 2 / STEPS - 0.5, hist[used, 1], hist[used, 0]))


def classify(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, predict_from: float = PREDICT_FROM) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `held_out`, `score` (0 to 1) and `predicted` (1 from `predict_from`).

    Null and empty texts have all-zero statistics and get that point's score. Without labelled rows every score
    is 0.5. Null ids are not held out; repeated rows are scored one by one and an id is
    learned from once, by the smallest statistics of its texts; an empty table
    gives an empty result. Statistics are computed once from whole texts and checkpointed, a hundred bytes a row.
    """
    stats = checkpointed(text_statistics(docs))
    model = fit(stats, labels, max_labelled)

    def run(batches):
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)
            score = model(x) if model is not None and len(x) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= predict_from).cast("int").alias("predicted"))
