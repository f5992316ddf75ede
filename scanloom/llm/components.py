"""Connected components of a graph that is a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import few_or_all, stage


def components(links: DataFrame) -> DataFrame:
    """The smallest node connected to each node of ``links`` (a, b): node, component.

    Each round takes the smallest label among the neighbours and then the label that this one had, so that chains shorten
    by more than half; rounds are written tables. Minima are formed before rows are moved, so that a hub is no burden.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")), "labels")
    while True:
        near = both.join(few_or_all(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        root = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        following = lower.join(few_or_all(root), "component").select("node", "before", F.col("root").alias("component"))
        following = stage(following, "labels")
        labels = following.select("node", "component")
        if following.filter("before != component").isEmpty():
            return labels
