"""Ranked selections: pools, diversified tops, budgets, keyword similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keyword_pairs(rows: DataFrame, key: str, least: float) -> DataFrame:
    """x, y, jaccard of rows (key, words) with similarity ``least`` or more, x < y.

    Pairs come from shared words; rows without one never meet.
    """
    words = rows.select(key, F.size("words").alias("n"), F.explode("words").alias("w"))
    a, b = (words.select(F.col(key).alias(k), F.col("n").alias(f"n{k}"), "w") for k in ("x", "y"))
    pairs = a.join(b, "w").where("x < y").groupBy("x", "y", "nx", "ny").agg(F.count(F.lit(1)).alias("o"))
    return pairs.select("x", "y", (F.col("o") / (F.col("nx") + F.col("ny") - F.col("o"))).alias("jaccard")).where(F.col("jaccard") >= least)


def decayed(support: Column, age_days: Column, half_life: float = 30.0) -> Column:
    return support * F.pow(F.lit(0.5), age_days / half_life)


def diversified(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The best of each group first, then the others, in order; n rows."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    few = rows.withColumn("_p", place).where(F.col("_p") <= n)  # a limit within each group, before any row moves
    return few.orderBy(F.col("_p") > 1, *order).limit(n).drop("_p")


def alternating(rows: DataFrame, pool: str, order: list[Column], n: int) -> DataFrame:
    """Pools take turns in the order of their names; n rows, with their place in the pool."""
    place = F.row_number().over(Window.partitionBy(pool).orderBy(*order))
    few = rows.withColumn("place", place).where(F.col("place") <= n)  # a limit within each pool, before any row moves
    return few.orderBy("place", pool).limit(n)


def within_budget(rows: DataFrame, group: str, order: list[Column], size: str, budget: int) -> DataFrame:
    """Of each group the longest ranked prefix whose sizes (positive) fit into the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)


def candidate_rank(support: Column, impact: Column, recency: Column, corrections: Column) -> Column:
    """Recurrence dominates; severity (1 to 2), recency (0.5 to 1) and corrections (1 to 2) are gentle factors."""
    severity = 1.0 + F.greatest(F.coalesce(impact, F.lit(0)), F.lit(0)) / 5.0
    grounding = 1.0 + 0.5 * F.least(F.greatest(F.coalesce(corrections, F.lit(0)), F.lit(0)), F.lit(2))
    return F.pow(F.greatest(support, F.lit(1)), F.lit(1.5)) * severity * (0.5 + 0.5 * F.least(F.greatest(recency, F.lit(0.0)), F.lit(1.0))) * grounding
