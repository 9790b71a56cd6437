"""Connected components of a table of edges, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftwright.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that edges lead to.

    Every round takes the smallest label of the neighbours and then the label of that label, so that long paths halve.
    It ends when nothing changes. Rounds are written to the shared folder; neighbours are counted by minimum within
    tasks first, so that a node with very many edges is no large group.
    """
    pairs = edges.where("a <> b").select("a", "b").distinct()
    both = cut(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = cut(
        both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a").agg(F.min("component").alias("low")).withColumnRenamed("a", "node")
        )
        lower = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "low").alias("low")
        )
        above = labels.select(F.col("node").alias("low"), F.col("component").alias("top"))
        after = cut(
            lower.join(above, "low").select("node", "old", F.least("low", "top").alias("component")), "labels"
        )
        labels = after.select("node", "component")
        if after.where("old <> component").isEmpty():
            return labels
