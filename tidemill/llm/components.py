"""Connected components of a link table, by smallest labels and pointer jumping over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); ``root`` is the smallest node that links reach.

    Every round, a node's label becomes the smallest among its own and its neighbours', and then its label's
    label; the tables are written, so no lineage grows and nothing is collected. No links give no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage(both, "links")
    labels = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("low"))
        lower = labels.join(near, labels.node == near.a).select("node", F.least("root", "low").alias("to"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("to_root"))
        moved = lower.join(jump, "to").select("node", F.least("to", "to_root").alias("root"), "was")
        moved = stage(moved, "labels")
        labels = moved.select("node", "root")
        if moved.where("root < was").isEmpty():
            return labels
