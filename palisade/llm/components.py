"""Connected components of a graph of links by least labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the least node of its component.

    A round takes the least label among a node's neighbours and then that label's own label, so long chains shorten
    by half each time; rounds end when nothing changes. Every round is checkpointed.
    """
    pairs = edges.select("a", "b").where("a <> b")
    both = cut(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(seen, labels.node == seen.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("n"), F.col("label").alias("top"))
        new = cut(near.join(up, near.label == up.n, "left").select("node", "old", F.least(F.coalesce("top", "label"), "label").alias("label")))
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels
