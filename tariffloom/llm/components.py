"""Connected components of a link table, on Spark only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffloom.llm.common import cut_lineage


def component_labels(links: DataFrame) -> DataFrame:
    """``node, label`` for every end of ``links`` (``a, b``): the smallest node that it reaches.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    that long chains shrink by halves; rounds stop when nothing changes.  The sum of the labels is
    all that reaches the driver.
    """
    both = cut_lineage(links.select("a", "b").unionAll(links.select(F.col("b"), F.col("a"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("mid"), F.col("label").alias("old"))
        own = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        moved = cut_lineage(met.join(own, "mid", "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("label"), "old"))
        changed = moved.filter("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
