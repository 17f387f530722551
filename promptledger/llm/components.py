"""Connected components of a graph by label spreading with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """`v` and `label`, the smallest vertex reachable, of every vertex of the links (`a`, `b`).

    Each round takes the smallest label among the neighbours, then jumps to the label's own label; rounds grow
    with the logarithm of the longest path. Every round is checkpointed, nothing is collected.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).toDF("v", "u").distinct())
    labels = checkpointed(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("near"))
        best = labels.join(near, "v").select("v", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("next"))
        new = checkpointed(best.join(jump, "label", "left").select(
            "v", F.least("label", F.coalesce("next", "label")).alias("label"), "old"))
        if new.where("label < old").isEmpty():
            return new.select("v", "label")
        labels = new.select("v", "label")
