"""Quality rules: counts per text, and a log-likelihood ratio between trusted and raw n-grams. DataFrame functions only."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, let, text_rows, words

BUCKETS = 1 << 13
SMOOTHING = 1.0
#: Mean log ratio per n-gram under which a text is rejected.
THRESHOLD = -0.25

_WINDOW = 3
#: Slots of the bit field that marks the trusted ids.
SLOTS = 1 << 24


def _repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text."""
    n = F.size(w)
    windows = F.when(n >= _WINDOW, F.transform(
        F.slice(w, 1, F.greatest(n - (_WINDOW - 1), F.lit(1))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    windows = F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))

    def starts(s: Column) -> Column:
        def like(x: Column, at: Column) -> Column:
            return F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))

        same = F.filter(s, lambda x, i: like(x, i + 1) | like(x, i - 1))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(_WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(_WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(F.sort_array(windows), starts)[0], covered)[0]


def _shapes(text: Column) -> Column:
    """Words with runs of small letters, capitals and digits reduced to one character each: `THE!!` gives `A!!`."""
    for kind, sign in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\p{Nd}+", "0")):
        text = F.regexp_replace(text, kind, sign)
    return words(text)


def _ngrams(w: Column, s: Column, buckets: int) -> Column:
    """Hash buckets of a text's word 1-grams and word-shape 2-grams."""
    m = F.lit(buckets)
    ones = F.transform(w, lambda x: F.pmod(F.xxhash64(x), m).cast("int"))
    twos = F.transform(s, lambda x, i: F.pmod(F.xxhash64(x, F.coalesce(F.get(s, i + 1), F.lit(""))), m).cast("int"))
    return F.concat(ones, twos)


def base_counts(docs: DataFrame) -> DataFrame:
    """The counts of every text by themselves, see `quality_rules`."""
    return _scored(docs, None, BUCKETS)


def _scored(docs: DataFrame, ratios: Column | None, buckets: int) -> DataFrame:
    t = F.col("text")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^" + SPACE[1:]))

    def per_text(w: Column) -> Column:
        fields = [F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")]
        if ratios is not None:
            grams = let(_shapes(t), lambda s: _ngrams(w, s, buckets))[0]
            total = F.aggregate(grams, F.lit(0.0), lambda a, x: a + F.get(ratios, x))
            fields.append(F.when(F.size(w) > 0, total / (2 * F.size(w))).otherwise(F.lit(0.0)).alias("log_ratio"))
        return F.struct(*fields)

    return text_rows(docs).select(
        "doc_id",
        (F.length(t) - F.regexp_count(t, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0].alias("n_dup_lines"),
        F.inline(let(words(t), per_text)))


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """`doc_id` and text of the rows whose `doc_id` is among `ids`.

    A bit field of fixed size lets most other rows end where they are read; the join by id decides. It is always a
    join by sorting, so what it moves grows with the marked texts at every size.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    ids = ids.select("doc_id").where("doc_id is not null").distinct()
    # At most SLOTS / 64 rows of 12 bytes.
    field = ids.select((slot / 64).cast("int").alias("_w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))").alias("_b")).groupBy(
        "_w").agg(F.bit_or("_b").alias("_bits"))
    rows = text_rows(docs).withColumn("_w", (slot / 64).cast("int")).join(F.broadcast(field), "_w")
    rows = rows.where(F.getbit("_bits", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")) == 1)
    # No semi-join: Spark would move it ahead of the bit field.
    return rows.select("doc_id", "text").join(ids.hint("merge"), "doc_id")


def _bucket_counts(rows: DataFrame, buckets: int) -> dict[int, int]:
    """Count of every bucket met in the texts; `buckets` rows at most."""
    grams = let(words(F.col("text")), lambda w: let(_shapes(F.col("text")), lambda s: _ngrams(w, s, buckets))[0])[0]
    counts = rows.select(F.explode(grams).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return {r["bucket"]: r["n"] for r in counts.collect()}


def ngram_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """log(P_trusted / P_raw) of every bucket.

    Both multinomials are counted over whole texts of all rows. The raw one is smoothed evenly, the trusted one
    towards the raw one with a mass of `smoothing` per bucket, so that little evidence gives ratios near 0.
    `trusted` holds the `doc_id`s of the trusted target; without any, every ratio is 0.
    """
    raw, good = _bucket_counts(text_rows(docs), buckets), _bucket_counts(_marked(docs, trusted), buckets)
    mass = smoothing * buckets
    raw_total, good_total = sum(raw.values()) + mass, sum(good.values()) + mass

    def ratio(bucket: int) -> float:
        share = (raw.get(bucket, 0) + smoothing) / raw_total
        return math.log((good.get(bucket, 0) + mass * share) / good_total / share)

    return [ratio(b) if good else 0.0 for b in range(buckets)]


def quality_rules(docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, threshold: float = THRESHOLD,
                  smoothing: float = SMOOTHING) -> DataFrame:
    """One row per row of `docs`: `doc_id`, counts, `base_failed`, `log_ratio` and `kept`.

    `word_chars` counts code points in words, `n_symbols` the characters of `#*$%&|<>`, `n_dup_lines` lines with
    a word that equal an earlier line, `n_repeat_words` the words in 3-word windows found twice or more.
    `base_failed`: under 50 words, or more than half of them repeat words. `log_ratio` is the mean over the
    text's n-grams of log(P_trusted / P_raw); a text is kept if it did not fail and the mean reaches
    `threshold`. A null text counts as empty; an empty one has zero counts, ratio 0 and fails. Repeated rows
    and null ids are judged row by row. An empty table gives an empty result.

    Scale: the counts are summed in the map tasks, so `buckets` rows leave each; the ratios are a literal
    of that fixed size, and the scoring pass shuffles nothing. Only trusted texts move, once, to meet their ids.
    """
    scored = _scored(docs, F.lit(np.array(ngram_ratios(docs, trusted, buckets, smoothing))), buckets)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), (~failed & (F.col("log_ratio") >= threshold)).alias("kept"),
                         "log_ratio")
