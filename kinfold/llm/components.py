"""Connected components of a graph of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.plans.staging import stage, unstage


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link.

    Every round hooks each component's label to the smallest label next to it and
    then halves the paths, so the rounds grow as the logarithm of the longest
    path.  Labels are tables in the shared folder; the driver sees one count a
    round.  A hot node's links meet only in partial minima and in joins that
    Spark can split.
    """
    links = stage(
        links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links"
    )
    both = links.union(links.select("b", "a"))
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    stale = [labels]
    while True:
        # links between what are now different components
        left = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        right = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        former = links
        links = stage(
            former.join(left, "a").join(right, "b").where("ca <> cb")
            .select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct(),
            "links",
        )
        unstage(former)
        hooks = links.groupBy("a").agg(F.min("b").alias("to"))
        parent = labels.select(F.col("node").alias("p"), F.col("component").alias("grand"))
        hooked = labels.join(hooks, labels["component"] == hooks["a"], "left").select(
            "node", F.coalesce("to", "component").alias("up")
        )
        new = stage(
            hooked.join(parent, hooked["up"] == parent["p"], "left").select(
                "node", F.coalesce("grand", "up").alias("component"), (F.col("grand") < F.col("up")).alias("moved")
            ),
            "labels",
        )
        moving = new.where("moved").limit(1).count()
        unstage(*stale)
        labels, stale = new.drop("moved"), [new]
        if not moving and links.isEmpty():
            return labels
