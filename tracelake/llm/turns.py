"""Turns of conversations in order, with positions, without a sort of one conversation in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm.common import shuffle_partitions, written

WORD = r"[^\x20\x09-\x0D]+"


def turn_key() -> Column:
    """128 bits that stand for (role, text); equal turns of a conversation's order go by it."""
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def keyed(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text (null: empty) and the turn's key."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    return rows.withColumn("key", turn_key())


def in_order(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Ranges of rows sorted by conversation and turn (null first); a long conversation is in many ranges."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("key").asc()]
    return rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)


def numbered(spark: SparkSession, conversations: DataFrame, **names: str) -> tuple[DataFrame, DataFrame]:
    """(turns: part, conv_id, pos from 1, key, words; runs: part, conv_id, before, n).

    A run is what a range of the sort has of a conversation: n turns, after
    ``before`` turns in earlier ranges. Texts don't leave the first stage.
    """
    rows = keyed(conversations, **names).where(F.col("conv_id").isNotNull())
    slim = rows.select("conv_id", "turn", "key", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    placed = in_order(spark, slim).select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "conv_id", "key", "words")
    placed = written(spark, placed, "turns")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("part", "conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    runs = written(spark, runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "turn-runs")
    pos = F.col("at") - F.col("first") + F.col("before") + 1
    return placed.join(runs, ["part", "conv_id"]).select("part", "conv_id", pos.alias("pos"), "key", "words"), runs.select("part", "conv_id", "before", "n")
