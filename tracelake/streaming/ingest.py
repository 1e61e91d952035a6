"""Incremental ingest: new files only, replays add nothing, touched sessions are recomputed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.sources.store import append_new, scratch


def summary(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


def ingest(spark: SparkSession, pattern: str, key: list[str], files_per_batch: int = 1) -> DataFrame:
    """Summaries of all sessions after every file that matches has been streamed in.

    Each batch appends the rows that are new and recomputes the sessions it
    touched from all their rows, so late rows need no watermark. The newest
    batch that touched a session has its summary.
    """
    folder = scratch(spark, "ingest")
    events, summaries = f"{folder}/events", f"{folder}/summaries"
    schema = spark.read.parquet(pattern).schema

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        stored = append_new(rows, events, key)
        whole = stored.join(rows.select("user_id").distinct(), "user_id", "left_semi")
        summary(whole).withColumn("batch", F.lit(number)).write.mode("append").parquet(summaries)
        rows.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(summaries)
    columns = [c for c in done.columns if c not in ("batch", "user_id")]
    newest = done.groupBy("user_id").agg(F.max_by(F.struct(*columns), "batch").alias("s"))
    return newest.select("user_id", "s.*")


def idle_sessions(events: DataFrame, idle: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """A streaming aggregate of sessions that close after an idle time (batch or stream)."""
    windows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", idle).alias("w"))
    return windows.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("closes"), "n")
