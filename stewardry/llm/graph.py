"""Connected components of a link table, level by level on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stewardry.session import materialise


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component`` for every node of ``links``; a component is named by its smallest node.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, which
    halves paths. Links and labels stay in tables of the shared folder; only the number of changes is counted.
    """
    both = links.select(F.col(left).alias("node"), F.col(right).alias("other")).filter("node != other")
    both = materialise(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = materialise(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("offer")), "other")
        offers = seen.groupBy("node").agg(F.min("offer").alias("offer"))
        nearer = labels.join(offers, "node").select("node", F.col("component").alias("was"), F.least("component", "offer").alias("near"))
        far = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        stepped = nearer.join(far, "near", "left").select("node", "was", F.least("near", F.coalesce("far", "near")).alias("component"))
        stepped = materialise(stepped, "labels")
        labels = stepped.select("node", "component")
        if stepped.filter("component != was").isEmpty():
            return labels
