"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import hot_join, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node.

    Each round takes the least label among a node and its neighbours, then the label's own label; labels are written
    once a round.  It ends when no label changes.  Neighbours of a node with very many meet its label by a broadcast."""
    both = written(edges.select("a", "b").filter("a <> b").union(edges.select(F.col("b"), F.col("a")).filter("a <> b")).distinct(), "edges")
    total = both.count()
    ends = both.withColumnRenamed("b", "node")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component"), F.count(F.lit(1)).alias("size")), "labels")
    while True:
        near = hot_join(ends, labels, "node", F.col("size"), total).groupBy("a").agg(F.min("component").alias("least"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "size", F.col("component").alias("before"), F.least("component", "least").alias("component"))
        lower = written(lower, "labels")
        jump = lower.select(F.col("node").alias("at"), F.col("component").alias("next"))
        found = written(lower.join(jump, F.col("component") == F.col("at"))
                        .select("node", "size", "before", F.least("component", "next").alias("component")), "labels")
        if found.filter("component <> before").isEmpty():
            return found.select("node", "component")
        labels = found.select("node", "size", "component")
