"""Connected components of links between ids, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.shared import discard, written


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of every node of links (a, b). Each round takes the least label among a node and its neighbours, then that label's own label, so stretches halve; it ends when nothing changes."""
    edges = written(links.filter("a != b").select("a", "b").union(links.filter("a != b").select("b", "a")).distinct(), "links")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    before = labels
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("onward"))
        after = written(lower.join(jump, "next").select("node", F.least("next", "onward").alias("new"), (F.least("next", "onward") < F.col("label")).alias("changed")), "labels")
        discard(before)
        before, labels = after, after.select("node", F.col("new").alias("label"))
        if not after.filter("changed").head(1):
            discard(edges)
            return labels
