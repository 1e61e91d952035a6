"""Operators over each session's ordered events: fills, anomalies, runs, turns, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def by(keys: str | list[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(*order)


def asof_fill(df: DataFrame, key: str, order: list[str], value: Column, out: str) -> DataFrame:
    """``out``: the latest non-null value at or before each row of its key."""
    w = by(key, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


# --- cost anomalies -------------------------------------------------------------------------


def cache_read_collapse(usage: DataFrame) -> DataFrame:
    """Turns whose cache reads fell by half or more while input stayed within a quarter.

    Both turns must be reported, not estimated, and adjacent.
    """
    w = by("session", "turn")
    pairs = usage.select("session", "turn", "data_source", "input", "cache_read", *(F.lag(c).over(w).alias(f"p_{c}") for c in ("data_source", "input", "cache_read")))
    steady = (F.col("p_input") > 0) & (F.abs(F.col("input") - F.col("p_input")) * 4 <= F.col("p_input"))
    fell = (F.col("p_cache_read") > 0) & (F.col("cache_read") * 2 <= F.col("p_cache_read"))
    return pairs.where((F.col("data_source") == "api") & (F.col("p_data_source") == "api") & steady & fell).select("session", "turn", "p_cache_read", "cache_read")


def input_spike(usage: DataFrame, factor: int = 3, baseline: int = 5) -> DataFrame:
    """Inputs above ``factor`` times the mean of the five reported inputs before; all five must exist."""
    w = by("session", "turn").rowsBetween(-baseline, -1)
    known = usage.where("data_source = 'api' AND input IS NOT NULL")
    pairs = known.select("session", "turn", "input", F.sum("input").over(w).alias("before"), F.count("input").over(w).alias("n"))
    return pairs.where((F.col("n") == baseline) & (F.col("input") * baseline > factor * F.col("before"))).select("session", "turn", "input", "before")


def model_shift(usage: DataFrame) -> DataFrame:
    """Turns whose model differs from the last known one."""
    w = by("session", "turn")
    pairs = usage.where("model IS NOT NULL").select("session", "turn", "model", F.lag("model").over(w).alias("previous"))
    return pairs.where("previous <> model")


def tier_shift(usage: DataFrame) -> DataFrame:
    """Turns whose service tier differs from the last known one under the same model."""
    w = by("session", "turn")
    known = usage.where("service_tier IS NOT NULL").select("session", "turn", "service_tier", "model", F.lag("service_tier").over(w).alias("previous"), F.lag("model").over(w).alias("p_model"))
    return known.where(F.col("model").eqNullSafe(F.col("p_model")) & (F.col("previous") != F.col("service_tier"))).select("session", "turn", "previous", "service_tier")


# --- runs and turns -------------------------------------------------------------------------


def loop_runs(events: DataFrame, fingerprint: Column, breaker: Column, least: int = 3) -> DataFrame:
    """Runs of equal fingerprints, at least ``least`` long: session, fingerprint, count, first and last event.

    Rows with a breaker end a run; rows without a fingerprint are passed over.
    """
    rows = events.select("session", "event_at", "event_id", fingerprint.alias("fingerprint"), breaker.alias("breaker"))
    rows = rows.where(F.col("fingerprint").isNotNull() | F.col("breaker"))
    order = by("session", "event_at", "event_id")
    new = F.col("breaker") | F.lag("breaker", 1, True).over(order) | ~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(order))
    marked = rows.withColumn("new", new.cast("int"))
    islands = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = islands.where(~F.col("breaker")).groupBy("session", "island", "fingerprint").agg(
        F.count(F.lit(1)).alias("count"), F.min_by("event_id", F.struct("event_at", "event_id")).alias("first_event"), F.max_by("event_id", F.struct("event_at", "event_id")).alias("last_event")
    )
    return runs.where(F.col("count") >= least).drop("island")


def turn_numbers(messages: DataFrame, key: str, order: list[str], is_user: Column) -> DataFrame:
    """``turn``: how many user messages there are up to each row."""
    w = by(key, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn("turn", F.sum(F.when(is_user, 1).otherwise(0)).over(w))


def gap_segments(events: DataFrame, key: str, ts: str, seconds: int, *ties: str) -> DataFrame:
    """``segment``: a new one wherever the time since the last known time reaches ``seconds``."""
    order = by(key, F.col(ts).asc_nulls_last(), *ties)
    last = F.last(ts, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = events.withColumn("_s", F.when(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(last.cast("timestamp")) >= seconds * 1_000_000, 1).otherwise(0))
    return starts.withColumn("segment", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s")


def token_deltas(snapshots: DataFrame, key: str, order: list[str], total: str) -> DataFrame:
    """``delta``: growth of a running total since the row before, never below 0."""
    return snapshots.withColumn("delta", F.greatest(F.col(total) - F.coalesce(F.lag(total).over(by(key, *order)), F.lit(0)), F.lit(0)))


def error_recovery(events: DataFrame, ok: Column, teachable: Column) -> DataFrame:
    """Each tool's last teachable error before a success of it: session, tool, error_event, success_event."""
    order = by(["session", "tool"], "event_at", "event_id")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.select("session", "tool", "event_at", "event_id", ok.alias("ok"), teachable.alias("bad"))
    rows = rows.withColumn("group", F.coalesce(F.sum(F.col("ok").cast("int")).over(past), F.lit(0)))
    at = F.struct("event_at", "event_id")
    pairs = rows.groupBy("session", "tool", "group").agg(
        F.max_by(F.when(F.col("bad"), F.col("event_id")), F.when(F.col("bad"), at)).alias("error_event"), F.max(F.when(F.col("ok"), F.col("event_id"))).alias("success_event")
    )
    return pairs.where("error_event IS NOT NULL AND success_event IS NOT NULL").drop("group")


def tool_mode(calls: Column, light: int = 3) -> Column:
    """Questions and answers, light or heavy use of tools in an exchange."""
    return F.when(calls == 0, "qa").when(calls <= light, "light").otherwise("heavy")
