"""Connected components of an edge table, as a few joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquifer.llm.common import freeze


def components(edges: DataFrame) -> DataFrame:
    """(v, c): for each end of (a, b) the smallest end that it is connected with.

    Every round gives a vertex the smallest label among its neighbours and then the label of that label, so
    the number of rounds grows with the logarithm of a chain's length; it ends when nothing changes.
    """
    both = freeze(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(
        edges.select(F.col("b").alias("v"), F.col("a").alias("w"))).distinct(), "edges")
    labels = freeze(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("c")), "labels")
    while True:
        near = (both.join(labels.select(F.col("v").alias("w"), F.col("c").alias("cw")), "w")
                .groupBy("v").agg(F.min("cw").alias("m")))
        spread = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        step = freeze(spread.join(jump, "c", "left").select(
            "v", "old", F.least("c", F.coalesce("cc", "c")).alias("c")), "labels")
        labels = step.select("v", "c")
        if step.where(F.col("old") != F.col("c")).isEmpty():
            return labels
