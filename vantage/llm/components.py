"""Connected components of an edge table, with nothing of the graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, comp) for each node of ``edges`` (a, b); comp is the smallest node reachable.

    Each round takes the least label among a node and its neighbours, then the label of that
    label, so long chains halve. Minima are combined before the shuffle; a hub's rows go through
    joins that adaptive execution can split. Labels are written after each round.
    """
    both = shelf.put(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = shelf.put(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"), F.lit(True).alias("moved")))
    while not labels.where("moved").isEmpty():
        sent = both.join(labels, both.a == labels.node).select(F.col("b").alias("node"), "comp", F.lit(None).cast("long").alias("was"))
        near = sent.unionByName(labels.select("node", "comp", F.col("comp").alias("was"))).groupBy("node").agg(F.min("comp").alias("comp"), F.max("was").alias("was"))
        up = near.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        new = shelf.put(near.join(up, "comp").select("node", F.col("top").alias("comp"), (F.col("top") != F.col("was")).alias("moved")))
        shelf.drop(labels)
        labels = new
    shelf.drop(both)
    return labels.select("node", "comp")
