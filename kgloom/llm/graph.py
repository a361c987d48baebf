"""Connected components by label propagation with pointer jumping, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the least node that links reach.

    Each round lowers every label to the least among a node's neighbours and then to that label's own label, so that
    chains halve. Labels are staged at each round, and those of the round before are deleted; nothing but a count reaches the driver.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root"))
    labels = stage(labels)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("least"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "least").alias("root"))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("further"))
        before, labels = labels, stage(lower.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root")))
        remove(before)
        if labels.where("root <> old").isEmpty():
            remove(both)
            return labels.select("node", "root")
        labels = labels.select("node", "root")
