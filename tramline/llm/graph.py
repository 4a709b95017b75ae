"""Connected components of a graph of links, over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node of its component.

    Each round a node takes the least label among its neighbours and itself, and then the label
    of that label, so the rounds grow with the logarithm of the longest path. Labels and links
    are written tables, so joins on a node with very many links can be split; sums over it are
    made before the shuffle. The loop ends when a round changes nothing.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = base.materialize(both, "links")
    labels = base.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "root")
        low = seen.unionByName(labels).groupBy("node").agg(F.min("root").alias("root"))
        low = base.materialize(low, "labels")
        jump = low.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = base.materialize(low.join(jump, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        done = after.join(labels.withColumnRenamed("root", "old"), "node").filter("root <> old").limit(1).isEmpty()
        base.discard(low, labels)
        labels = after
        if done:
            base.discard(both)
            return labels
