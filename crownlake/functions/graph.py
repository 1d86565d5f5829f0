"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed

c = F.col


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (the least node) for edges (a, b); ``nodes`` (node) may add ones without edges.

    Each round a node takes the least label among its neighbours, its label's node takes it too, and labels
    are followed one step, so that long paths need rounds by the logarithm of their length. Rounds are
    joins and sums over edges, cut by reliable checkpoints; no component is gathered in one place.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(c("b").alias("a"), c("a").alias("b"))).filter("a <> b").distinct(), small=True)
    every = both.select(c("a").alias("node"))
    every = every.unionByName(nodes.select("node")) if nodes is not None else every
    labels = checkpointed(every.distinct().withColumn("component", c("node")), small=True)
    while True:
        seen = both.join(labels.select(c("node").alias("b"), c("component").alias("fb")), "b").join(labels.select(c("node").alias("a"), c("component").alias("fa")), "a")
        better = seen.filter("fb < fa").select(F.explode(F.array("a", "fa")).alias("node"), c("fb").alias("component"))
        up = labels.select(c("node").alias("component"), c("component").alias("up"))
        followed = labels.join(up, "component").select("node", c("up").alias("component"))
        new = better.unionByName(followed).groupBy("node").agg(F.min("component").alias("least"))
        new = checkpointed(labels.join(new, "node", "left").select("node", c("component").alias("old"), F.least("component", F.coalesce("least", "component")).alias("component")), small=True)
        labels = new.select("node", "component")
        if new.filter("component <> old").isEmpty():
            return labels
