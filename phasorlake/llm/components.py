"""Connected components of a graph that is held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(x, y) edges -> (node, label): the smallest node that each node reaches.

    Contraction: every node hooks to the smallest of itself and its neighbours, hooks are followed once
    more, and the edges between what is left make the next, smaller graph. A node that isn't the smallest
    around always hooks, so a component halves at least. Each step is written out; nothing but the number
    of edges left reaches the driver."""
    edges = stored(edges.select("x", "y").where("x != y").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("y", "x"))
        hook = both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("to"))
        hook = stored(hook, "hooks")
        far = hook.select(F.col("node").alias("to"), F.col("to").alias("top"))
        hook = stored(hook.join(far, "to").select("node", F.col("top").alias("to")), "hooks")
        if labels is None:
            labels = hook.select("node", F.col("to").alias("label"))
        else:
            step = hook.select(F.col("node").alias("label"), "to")
            labels = stored(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        left, right = hook.select(F.col("node").alias("x"), F.col("to").alias("a")), hook.select(F.col("node").alias("y"), F.col("to").alias("b"))
        moved = edges.join(left, "x").join(right, "y").where("a != b").select(F.col("a").alias("x"), F.col("b").alias("y"))
        edges = stored(moved.distinct(), "edges")
    if labels is None:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("label"))
    return labels
