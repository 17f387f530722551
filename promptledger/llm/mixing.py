"""Mixing sources to target weights: a Pfair schedule of source blocks. DataFrame functions only."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_CHARS = 1 << 20
CELL_ROWS = 4096
OTHER = "*"


def edf_template(shares: list[int]) -> list[list[tuple[int, int, int]]]:
    """One hyperperiod: for each lane the (slot, release, deadline) of its blocks.

    With L = sum(shares), block j of a lane with share a may not start before floor(j L / a) and has to be out
    by ceil((j + 1) L / a). Earliest deadline first meets every deadline, as the lanes' rates sum to one, so a
    lane's count never differs from its due share by a whole block. After L slots all lanes are even again and
    the same template repeats, however long the corpus is.
    """
    if not shares or any(a < 1 for a in shares):
        raise ValueError("every lane needs a share of 1 or more")
    total = sum(shares)
    out: list[list[tuple[int, int, int]]] = [[] for _ in shares]
    for slot in range(total):
        ready = []
        for lane, a in enumerate(shares):
            j = len(out[lane])
            if j < a and j * total // a <= slot:
                ready.append((-(-(j + 1) * total // a), lane))
        deadline, lane = min(ready)
        assert slot < deadline
        out[lane].append((slot, len(out[lane]) * total // shares[lane], deadline))
    return out


def mix(docs: DataFrame, shares: dict[str, int], *, block_chars: int = BLOCK_CHARS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """`docs` with the columns `mix_lane`, `mix_block`, `mix_slot`, `mix_release`, `mix_deadline` and `mix_at`.

    `shares` maps sources to whole target shares; `"*"` (1 unless given) stands for all other sources, null
    included. A lane's texts are strung together in hashed order and cut every `block_chars` characters; a text
    belongs to the block it starts in, at `mix_at`. Sorting by (`mix_slot`, `mix_at`) gives the mixture: up to
    any slot each lane that is not used up has its share of the blocks to less than one block. Every row keeps
    its place once a lane ends; the others go on in their proportions. No row is dropped or repeated. Null and
    empty texts have length 0; repeated rows are placed one by one; an empty table stays empty. Columns of
    `docs` under the new names are replaced.

    Scale: lanes are split into cells of about `cell_rows` rows by hash, so a source with a third of all rows is
    many small windows; offsets come from one sum per cell.
    """
    shares = {OTHER: 1} | shares
    names, plan = list(shares), edf_template(list(shares.values()))
    made = ("mix_lane", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_at")
    keep = [c for c in docs.columns if c not in made]
    named = F.array(*[F.lit(n) for n in names])
    source = F.coalesce(F.col("source").cast("string"), F.lit(OTHER))
    lane = F.greatest(F.array_position(named, source) - 1, F.lit(0))  # lane 0 takes all that are not named
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    # The columns travel in a struct, so none of their names can clash with those used here.
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), lane.cast("int").alias("lane"), size.alias("size"),
                       F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("ord"))
    # At most one row per lane, and the lanes are a parameter.
    cells = base.groupBy("lane").agg(F.ceil(F.count("*") / cell_rows).alias("cells"))
    base = base.join(F.broadcast(cells), "lane").withColumn("cell", F.pmod("ord", "cells"))
    key = ["lane", "cell"]
    upto = Window.partitionBy("lane").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = base.groupBy(*key).agg(F.sum("size").alias("s")).select(*key, F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("start"))
    before = Window.partitionBy(*key).orderBy("ord", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("size").over(before), F.lit(0))

    def by_lane(values: list[int]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("lane"))

    flat = [b for blocks in plan for b in blocks]
    firsts = [sum(len(b) for b in plan[:i]) for i in range(len(plan))]
    share = by_lane([len(b) for b in plan])
    placed = base.withColumn("at", inside).join(starts, key).withColumn("at", F.col("start") + F.col("at")) \
        .withColumn("block", F.floor(F.col("at") / block_chars))
    placed = placed.withColumn("of", (by_lane(firsts) + F.col("block") % share).cast("int")).withColumn(
        "round", F.floor(F.col("block") / share) * len(flat))

    def scheduled(k: int) -> Column:
        return F.col("round") + F.get(F.array(*[F.lit(b[k]) for b in flat]), F.col("of"))

    return placed.select(*[F.col("row").getField(c).alias(c) for c in keep], F.get(named, F.col("lane")).alias("mix_lane"),
                         F.col("block").alias("mix_block"), scheduled(0).alias("mix_slot"), scheduled(1).alias("mix_release"),
                         scheduled(2).alias("mix_deadline"), F.col("at").alias("mix_at"))


def lag(count: int, slot: int, share: int, total: int) -> Fraction:
    """How far a lane is behind (or, negative, ahead of) its due share after `slot` slots, in blocks."""
    return Fraction(share * slot, total) - count
