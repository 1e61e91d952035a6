"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import written


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for all nodes on ``edges`` (u, v).

    Rounds of hooking to the smallest neighbouring label and of jumping to
    the label's own label; their number grows with the logarithm of the
    longest path. Each round ends in a written table.
    """
    both = edges.where("u <> v").select("u", "v")
    both = written(spark, both.union(both.select("v", "u")).distinct(), "edges")
    labels = written(spark, both.groupBy("u").agg(F.least("u", F.min("v")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("c").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        hooked = labels.join(near, "u").select("u", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        above = labels.select(F.col("u").alias("c"), F.col("c").alias("top"))
        jumped = hooked.join(above, "c").select("u", "old", F.least("c", "top").alias("c"))
        labels = written(spark, jumped, "labels")
        if labels.where("c <> old").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))
        labels = labels.select("u", "c")
