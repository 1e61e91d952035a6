"""The stored tables as tables of the trace model.

The supplied star schema carries no agent traces, so each adapter names the
columns that stand in for the trace model's; ``*_SQL`` is the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.plans.registry import table


def recorder_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorder events: session, type, event_at, client, confidence, event_key, source."""
    e = table(spark, sf_dir, "events")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (F.pmod(n, F.lit(len(names))) + 1).cast("int"))
    return e.select(
        "event_id", F.col("user_id").alias("session"), F.col("event_type").alias("type"), F.col("ts").alias("event_at"), "value", "props",
        pick(F.col("user_id"), "claude", "codex", "openclaw").alias("client"),
        pick(F.col("event_id"), "high", "medium", "low", "missing").alias("confidence"),
        pick(F.col("event_id"), "vendor", "hook").alias("source"),
        F.when(F.col("event_id") % 11 != 0, F.concat(F.col("event_type"), F.lit(":"), (F.col("event_id") % 37).cast("string"))).alias("event_key"),
    )


RECORDER_EVENTS_SQL = """(SELECT event_id, user_id AS session, event_type AS type, ts AS event_at, value, props,
  (['claude', 'codex', 'openclaw'])[CAST(user_id % 3 + 1 AS INTEGER)] AS client,
  (['high', 'medium', 'low', 'missing'])[CAST(event_id % 4 + 1 AS INTEGER)] AS confidence,
  (['vendor', 'hook'])[CAST(event_id % 2 + 1 AS INTEGER)] AS source,
  CASE WHEN event_id % 11 <> 0 THEN concat(event_type, ':', CAST(event_id % 37 AS VARCHAR)) END AS event_key
  FROM events)"""


def usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token usage: session, turn, model, data_source, service_tier, input, output, cache_read."""
    li = table(spark, sf_dir, "lineitem")
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("l_partkey") % len(MODELS) + 1).cast("int"))
    return li.select(
        (F.col("l_orderkey") % 997).alias("session"), F.expr("((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey % 10000").alias("turn"),
        F.when(F.col("l_partkey") % 13 != 0, model).alias("model"),
        F.when(F.col("l_returnflag") == "A", "estimated").otherwise("api").alias("data_source"),
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_linestatus")).alias("service_tier"),
        F.when(F.col("l_suppkey") % 7 != 0, F.col("l_quantity").cast("long") * 100).alias("input"),
        (F.col("l_extendedprice") / 10).cast("long").alias("output"),
        (F.col("l_discount") * 100000).cast("long").alias("cache_read"),
        F.lit(0).cast("long").alias("cache_write"), F.lit(0).cast("long").alias("reasoning"), "l_shipdate",
    )


# Model names that the ledger carries.
MODELS = ("claude-opus-4-1", "anthropic/claude-sonnet-4-5", "gpt-5-mini", "o3-mini", "gemini-2.5-pro", "mystery-1", "gpt-4.1-mini-2025")
USAGE_SQL = f"""(SELECT l_orderkey % 997 AS session, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey % 10000 AS turn,
  CASE WHEN l_partkey % 13 <> 0 THEN ({list(MODELS)})[CAST(l_partkey % {len(MODELS)} + 1 AS INTEGER)] END AS model,
  CASE WHEN l_returnflag = 'A' THEN 'estimated' ELSE 'api' END AS data_source,
  CASE WHEN l_suppkey % 5 <> 0 THEN l_linestatus END AS service_tier,
  CASE WHEN l_suppkey % 7 <> 0 THEN CAST(trunc(l_quantity) AS BIGINT) * 100 END AS input,
  CAST(trunc(l_extendedprice / 10) AS BIGINT) AS output, CAST(trunc(l_discount * 100000) AS BIGINT) AS cache_read,
  0 AS cache_write, 0 AS reasoning, l_shipdate FROM lineitem)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session headers: orders as sessions, customers as logical families and projects."""
    o = table(spark, sf_dir, "orders")
    scored = F.col("o_orderkey") % 4 != 0
    return o.select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("logical_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("task_type"), F.col("o_orderdate").alias("started_at"),
        F.expr("o_orderdate + make_interval(0, 0, 0, 0, 0, CAST(o_orderkey % 300 AS INT), 0)").alias("ended_at"),
        F.when(scored, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("score"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("cost"),
        F.element_at(F.array(*map(F.lit, MODELS)), (F.col("o_custkey") % len(MODELS) + 1).cast("int")).alias("model"),
        F.element_at(F.array(*map(F.lit, OUTCOMES)), (F.col("o_orderkey") % len(OUTCOMES) + 1).cast("int")).alias("outcome"),
        F.concat(F.lit("claude:proj"), (F.col("o_custkey") % 17).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ":sub").otherwise("")).alias("session_key"),
        (F.col("o_orderkey") % 6).cast("int").alias("interrupts"),
        F.when(F.col("o_orderkey") % 10 == 0, "embargoed").when(F.col("o_orderkey") % 10 == 1, "pending_review").when(F.col("o_orderkey") % 10 == 2, "released").otherwise("auto_redacted").alias("hold_state"),
        F.when(F.col("o_orderkey") % 10 == 0, F.date_add(F.to_date("o_orderdate"), 30)).alias("embargo_until"),
    )


# Outcomes that sessions carry.
OUTCOMES = ("resolved", "partial", "failed", "abandoned", "resolved")
SESSIONS_SQL = f"""(SELECT o_orderkey AS session_id, o_custkey AS logical_id, o_orderstatus AS status, o_orderpriority AS task_type,
  o_orderdate AS started_at, o_orderdate + to_minutes(CAST(o_orderkey % 300 AS INTEGER)) AS ended_at,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 5 + 1 AS INTEGER) END AS score, CAST(o_totalprice AS DECIMAL(18,2)) AS cost,
  ({list(MODELS)})[CAST(o_custkey % {len(MODELS)} + 1 AS INTEGER)] AS model, ({list(OUTCOMES)})[CAST(o_orderkey % {len(OUTCOMES)} + 1 AS INTEGER)] AS outcome,
  concat('claude:proj', CAST(o_custkey % 17 AS VARCHAR), CASE WHEN o_orderkey % 3 = 0 THEN ':sub' ELSE '' END) AS session_key,
  CAST(o_orderkey % 6 AS INTEGER) AS interrupts,
  CASE o_orderkey % 10 WHEN 0 THEN 'embargoed' WHEN 1 THEN 'pending_review' WHEN 2 THEN 'released' ELSE 'auto_redacted' END AS hold_state,
  CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_orderdate AS DATE) + 30 END AS embargo_until FROM orders)"""
