"""Connected components by minimum labels with pointer jumping, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every end of `links` (a, b): label is the least node of its component. Runs until nothing moves."""
    both = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.toDF("a", "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        far = labels.toDF("new", "far")
        jumped = written(least.join(far, "new", "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new")), "labels")
        labels = jumped.select("node", F.col("new").alias("label"))
        if jumped.filter("new <> label").isEmpty():
            return labels
