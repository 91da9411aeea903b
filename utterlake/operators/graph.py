"""Connected components of records that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written


def components(edges: DataFrame) -> DataFrame:
    """node, key pairs -> node, component: the smallest node of everything tied by shared keys.

    A key of one node ties nothing, so only nodes with shared keys go through the rounds; the others are their own component.
    Labels are lowered by joins through the keys and by jumping to the label of the label, so the number of rounds grows
    with the logarithm of the longest chain; each round is cut off as a written table.
    """
    every = edges.where("node is not null and key is not null").select("node", "key")
    shared = every.groupBy("key").agg((F.min("node") != F.max("node")).alias("ties")).where("ties").select("key")
    graph = written(every.join(shared, "key").select("node", "key").distinct())
    alone = every.select("node").distinct().join(graph.select("node").distinct(), "node", "left_anti").select("node", F.col("node").alias("component"))
    labels = written(graph.groupBy("node").agg(F.first("node").alias("component")))
    while True:
        least = graph.join(labels, "node").groupBy("key").agg(F.min("component").alias("least"))
        near = graph.join(least, "key").groupBy("node").agg(F.min("least").alias("near"))
        lowered = written(labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old")))
        jump = lowered.select(F.col("node").alias("component"), F.col("component").alias("via"))
        new = written(lowered.join(jump, "component", "left").select("node", F.least("component", "via").alias("component"), "old"))
        if new.where("component <> old").isEmpty():
            return new.select("node", "component").unionByName(alone)
        labels = new.select("node", "component")
