"""One row per event key: base events merged with their overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Ranks of confidences.
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1, "missing": 0}


def confidence_rank(confidence: Column) -> Column:
    rank = F.lit(0)
    for name, value in CONFIDENCE_RANK.items():
        rank = F.when(confidence == name, value).otherwise(rank)
    return rank


def first_per_key(events: DataFrame) -> DataFrame:
    """The first event of each (session, event_key); events without a key all stay."""
    order = Window.partitionBy("session", "event_key").orderBy(F.col("event_at").asc_nulls_last(), "event_id")
    keyed = events.where("event_key IS NOT NULL").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return keyed.unionByName(events.where("event_key IS NULL"))


def winning_overrides(overrides: DataFrame) -> DataFrame:
    """Of each key's overrides the first of the highest rank: a later one must rank strictly higher."""
    order = Window.partitionBy("session", "event_key").orderBy(confidence_rank(F.col("confidence")).desc(), "write_seq")
    return overrides.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def merged(events: DataFrame, overrides: DataFrame) -> DataFrame:
    """session, event_key, type, confidence, origin of base rows with their overrides.

    An override of equal or higher rank replaces type and confidence; one
    without a base row appears by itself.
    """
    base = first_per_key(events).select("session", "event_key", "type", "confidence", F.lit(True).alias("base"))
    over = winning_overrides(overrides).select("session", "event_key", F.col("type").alias("o_type"), F.col("confidence").alias("o_confidence"))
    both = base.join(over, ["session", "event_key"], "full_outer")
    wins = F.col("o_type").isNotNull() & (F.col("base").isNull() | (confidence_rank(F.col("o_confidence")) >= confidence_rank(F.col("confidence"))))
    return both.select(
        "session", "event_key", F.when(wins, F.col("o_type")).otherwise(F.col("type")).alias("type"),
        F.when(wins, F.col("o_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("base").isNull(), "hook_only").when(wins, "override").otherwise("base").alias("origin"),
    )


def capability_states(events: DataFrame, matrix: DataFrame) -> DataFrame:
    """(session, client, type, state) for all types a client's row of ``matrix`` (client, type, supported) names.

    observed, or supported but absent, or unsupported. The matrix has a row
    for each client and type, so it may be broadcast.
    """
    seen = events.groupBy("session", "client", "type").agg(F.count(F.lit(1)).alias("n"))
    wanted = events.select("session", "client").distinct().join(F.broadcast(matrix), "client")
    state = F.when(F.col("n").isNotNull(), "observed").when(F.col("supported"), "absent").otherwise("unsupported")
    return wanted.join(seen, ["session", "client", "type"], "left").select("session", "client", "type", state.alias("state"))
