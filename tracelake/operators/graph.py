"""Session trees and interval children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET = 3600


def tree_depths(nodes: DataFrame) -> DataFrame:
    """node, root, depth from (node, parent), by a recursive query from the roots down.

    A parent that is no node counts as none. Nodes on or below a cycle have no
    root and drop out. The session's spark.sql.cteRecursionLevelLimit bounds
    the depth.
    """
    own = nodes.select(F.col("node").alias("p"))
    known = nodes.join(own, F.col("parent") == F.col("p"), "left").select("node", F.col("p").alias("parent"))
    return nodes.sparkSession.sql(
        """WITH RECURSIVE tree(node, root, depth) AS (
             SELECT node, node, 0 FROM {known} WHERE parent IS NULL
             UNION ALL SELECT k.node, t.root, t.depth + 1 FROM {known} k JOIN tree t ON k.parent = t.node)
           SELECT node, root, depth FROM tree""",
        known=known,
    )


def interval_children(spans: DataFrame, project: str, bucket: int = BUCKET) -> DataFrame:
    """child, parent: each span's first claimer, a span of its project that is open when it starts.

    ``spans``: id, project, started, ended. First claimer: earliest start,
    then smallest id. A parent's span is laid over time buckets. Within a
    bucket, only a span that ends later than all before it can be a first
    claimer, and the ends of these ascend: the first one that has not ended at
    a child's start is the next one in the order of ends, so that rows are
    sorted and never paired, however many start at once. Children whose id is
    on several rows are paired, as a span is no claimer of its own id.
    """
    slot = lambda c: F.floor(F.unix_timestamp(c) / bucket)
    known = spans.select("id", F.col(project).alias("project"), "started", "ended").where("id IS NOT NULL AND project IS NOT NULL AND started IS NOT NULL")
    parents = known.where("ended >= started").select("project", F.explode(F.sequence(slot("started"), slot("ended"))).alias("slot"), F.struct("started", "id").alias("own"), F.col("ended").alias("at"), F.lit(True).alias("opens"))
    children = known.select("project", slot("started").alias("slot"), F.struct("started", "id").alias("own"), F.col("started").alias("at"), F.lit(False).alias("opens"))
    rows = parents.unionByName(children)
    before = Window.partitionBy("project", "slot").orderBy("own").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.when(F.col("opens"), F.col("at"))).over(before)
    rows = rows.withColumn("latest", latest).where("NOT opens OR latest IS NULL OR at > latest")
    # At one time an end comes after the starts, so that a span is open at its end.
    after = Window.partitionBy("project", "slot").orderBy(F.col("at").desc(), F.col("opens").desc(), F.col("own").desc()).rowsBetween(Window.unboundedPreceding, -1)
    claimer = F.last(F.when(F.col("opens"), F.col("own")), ignorenulls=True).over(after)
    found = rows.withColumn("claimer", claimer).where("NOT opens AND claimer < own").select(F.col("own.id").alias("child"), F.col("claimer.id").alias("parent"))

    repeated = known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if repeated.isEmpty():
        return found
    several = known.join(repeated, "id", "left_semi").select(F.col("id").alias("child"), "project", "started", slot("started").alias("slot"))
    pairs = parents.join(several, ["project", "slot"]).where("started BETWEEN own.started AND at AND child <> own.id AND own < struct(started, child)")
    return found.join(repeated, F.col("child") == F.col("id"), "left_anti").unionByName(pairs.groupBy("child").agg(F.min("own")["id"].alias("parent")))
