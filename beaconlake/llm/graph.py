"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) from links (a, b); nodes without a link are absent.

    Each round a node takes the smallest label around it and then its label's label; the tables stay distributed and
    each round is written, until no label changes.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = step.join(labels.select(F.col("node").alias("at"), F.col("label").alias("next")), F.col("label") == F.col("at"), "left")
        jump = stored(jump.select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        labels = jump.select("node", "label")
        if jump.filter("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
