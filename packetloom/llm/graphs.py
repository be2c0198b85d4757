"""Connected components of links between classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import fitted, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) of links (a, b): label is the smallest node reachable.

    Each round gives every node the smallest label of its neighbours and then follows labels once,
    so that paths shorten by half; sums of small rows only, written to shared storage each round.
    links are read in every round.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b")
    labels = stored(fitted(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")), 2 * links.count()), "labels")
    nodes = labels.count()
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), "label")
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        after = stored(fitted(step.join(jump, "to").select(
            "node", F.least("to", "further").alias("label"),
            (F.least("to", "further") != F.col("label")).alias("moved")), nodes), "labels")
        labels = after.select("node", "label")
        if not after.filter("moved").limit(1).count():
            return labels
