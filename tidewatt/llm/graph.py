"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """node and label (the component's smallest node) of every node of the
    edges (a, b).  Each round takes the neighbours' smallest label and then
    the label's own label; every round is a stored table, and messages are
    pre-aggregated, so a hub's links never meet in one task."""
    pairs = edges.select("a", "b")
    both = common.store(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = common.store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("met"))
        lower = labels.join(seen, labels.node == seen.a).select("node", F.least("label", "met").alias("label"), F.col("label").alias("before"))
        root = lower.select(F.col("node").alias("root"), F.col("label").alias("above"))
        following = common.store(lower.join(root, F.col("label") == F.col("root")).select("node", F.least("label", "above").alias("label"), "before"), "labels")
        moved = following.where("label <> before").limit(1).count()
        common.discard(labels)
        labels = following
        if not moved:
            common.discard(both)
            return labels.select("node", "label")
