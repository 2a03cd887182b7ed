"""Connected components by hooking and contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpointed, tidy


def _roots(parents: DataFrame) -> DataFrame:
    """(node, label) with the root of each node's tree, by pointer jumping; ``parents``: (node, label), label < node."""
    while True:
        up = parents.select(F.col("node").alias("via"), F.col("label").alias("top"))
        moved = checkpointed(parents.join(up, F.col("label") == F.col("via"), "left").select("node", F.coalesce("top", "label").alias("label"), F.col("top").isNotNull().alias("moved")))
        tidy(parents.sparkSession)
        if moved.filter("moved").isEmpty():
            return moved.select("node", "label")
        parents = moved.select("node", "label")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes in ``links`` (a, b); the label is the least node of the component.

    Each node hooks on to its least neighbour, if that is less. The trees that come of it are flattened by
    pointer jumping, in as many rounds as the logarithm of their height, and each becomes one node
    of the next, smaller graph, which has only the links between different trees. A link is thus
    read once or twice, not in every round.
    """
    spark = links.sparkSession
    left = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    while labels is None or not left.isEmpty():
        roots = _roots(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
        one, two = roots.select(F.col("node").alias("a"), F.col("label").alias("x")), roots.select(F.col("node").alias("b"), F.col("label").alias("y"))
        ends = left.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
        next_left = checkpointed(ends.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        if labels is None:
            every = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
            labels = every.join(roots, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
        else:
            top = roots.select(F.col("node").alias("label"), F.col("label").alias("top"))
            labels = labels.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
        labels = checkpointed(labels)
        left = next_left
        tidy(spark)
    return labels
