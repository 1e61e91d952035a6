"""Folders that all executors share, and idempotent writes into them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; on a local master one is made where the session names none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-tracelake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where a small table lies in fewer files than there are cores; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system that its URI names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def append_new(rows: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Appends the rows whose key is not there yet; returns what the table then holds.

    Replaying a batch adds nothing.
    """
    spark = rows.sparkSession
    new = rows.dropDuplicates(key)
    if exists(spark, path):
        new = new.join(spark.read.schema(rows.schema).parquet(path).select(*key), key, "left_anti")
    new.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def session_headers(events: DataFrame) -> DataFrame:
    """One header for each session: first start, last end, first known version, an end that sticks."""
    return events.groupBy("session").agg(
        F.min("event_at").alias("started_at"), F.max("event_at").alias("ended_at"),
        F.min_by("client", F.when(F.col("client").isNotNull(), F.struct("event_at", "event_id"))).alias("client"), F.bool_or(F.col("type") == "signup").alias("ended"),
    )


def snapshot_upsert(old: DataFrame, new: DataFrame, key: str, revision: str, kept: list[str]) -> DataFrame:
    """The table after an upsert: columns ``kept`` survive only while the revision stays the same."""
    o = old.select(F.col(key), *(F.col(c).alias(f"_o_{c}") for c in old.columns if c != key))
    both = o.join(new, key, "full_outer")
    same = F.col(revision).eqNullSafe(F.col(f"_o_{revision}"))
    gone = F.col(revision).isNull()

    def column(c: str):
        if c in kept:
            return F.when(gone | same, F.col(f"_o_{c}")).otherwise(F.col(c) if c in new.columns else F.lit(None)).alias(c)
        return F.when(gone, F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c)

    return both.select(key, *(column(c) for c in old.columns if c != key))


def training_turns(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Training rows: each user message with the replies up to the next one, in order."""
    from tracelake.operators.sequence import turn_numbers

    ordered = messages.withColumnRenamed(order, "message")
    turns = turn_numbers(ordered, key, ["message"], F.col("role") == "user").where("turn > 0")
    parts = F.array_sort(F.collect_list(F.struct("message", "role", "text")))
    rows = turns.groupBy(key, "turn").agg(parts.alias("p"))
    return rows.select(
        F.concat_ws("-", key, "turn").alias("turn_id"), F.col("p")[0]["text"].alias("input"),
        F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: x["text"]).alias("output"),
    )


def export_jsonl(df: DataFrame, columns: list[str], path: str) -> DataFrame:
    """Writes the allowed columns as JSON lines; returns the manifest (rows, digest of row digests)."""
    lines = df.select(F.to_json(F.struct(*columns)).alias("value"))
    lines.write.text(path)
    return manifest(lines)


def manifest(lines: DataFrame) -> DataFrame:
    """Rows and an order-free digest: the sum of the lines' 64-bit hashes."""
    return lines.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("value").cast("decimal(20,0)")).cast("string").alias("digest"))
