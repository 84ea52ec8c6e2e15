"""Connected components of links, by repeated contraction; each round is a few joins and a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes in `links` (a, b).

    In each round every node takes the label of its smallest neighbour's smallest neighbour; links between labels go
    on. Stars end after one round, chains after a number that grows with the logarithm of their length. A node with
    very many links costs one row per task (partial minimum) and a join that Spark splits.
    """
    edges = stored(links.select("a", "b").filter("a <> b").distinct(), "links")
    labels: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up")), "labels")
        above = least.select(F.col("a").alias("up"), F.col("up").alias("top"))
        step = stored(least.join(above, "up").select(F.col("a").alias("node"), F.col("top").alias("label")), "labels")
        if labels is None:
            labels = step
        else:
            moved = step.select(F.col("node").alias("component"), "label")
            labels = stored(labels.select("node", F.col("label").alias("component")).join(moved, "component", "left")
                            .select("node", F.coalesce("label", "component").alias("label")), "labels")
        at_a, at_b = step.select(F.col("node").alias("a"), F.col("label").alias("x")), step.select(F.col("node").alias("b"), F.col("label").alias("y"))
        edges = stored(edges.join(at_a, "a").join(at_b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("label").alias("component"))
