"""Connected components of a graph whose edges lie in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """node and label of every node that has an edge (columns a, b); label is one node of its component.

    Each round, nodes hook onto their least neighbour, parents are followed twice, and edges are
    redrawn between the parents; those inside one node vanish. Nothing is gathered on the driver but
    whether edges are left.
    """
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        parent = written(parent, "parents")
        for _ in range(2):
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parent = written(parent.join(above, "up").select("node", F.col("top").alias("up")), "parents")
        if labels is None:
            labels = parent.withColumnRenamed("up", "label")
        else:
            step = parent.select(F.col("node").alias("label"), "up")
            labels = written(labels.join(step, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        for end in ("a", "b"):
            edges = edges.join(parent.select(F.col("node").alias(end), "up"), end).drop(end).withColumnRenamed("up", end)
        edges = written(edges.filter("a <> b").distinct(), "edges")
    return labels
