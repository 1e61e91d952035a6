"""Aggregation queries: the declarative aggregate, dashboards, insights, advisor figures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.text import BADGE_OUTCOMES, JUDGED_OUTCOMES, normalized_badge
from tracelake.functions.time import duration_seconds, week_of_year
from tracelake.operators.aggregate import Domain, Metric, Predicate, Spec, aggregate, with_totals
from tracelake.plans.registry import query, table
from tracelake.sources.adapters import RECORDER_EVENTS_SQL, SESSIONS_SQL, USAGE_SQL, recorder_events, sessions, usage_ledger

SINCE = datetime(2024, 1, 10)


def events_domain() -> Domain:
    return Domain(
        dims={
            "client": F.col("client"), "type": F.col("type"), "confidence": F.col("confidence"), "source": F.col("source"),
            "session": F.col("session"), "date": F.date_format("event_at", "yyyy-MM-dd"), "hour": F.date_format("event_at", "yyyy-MM-dd'T'HH"),
        },
        time=F.col("event_at"),
    )


def cost_domain() -> Domain:
    return Domain(
        dims={"model": F.col("model"), "data_source": F.col("data_source"), "service_tier": F.col("service_tier"), "session": F.col("session")},
        fields={"input": F.col("input"), "output": F.col("output"), "cache_read": F.col("cache_read")},
        time=F.col("l_shipdate"),
        partition_by="data_source",
    )


def money(total: str = "cost", name: str = "total_cost"):
    """An exact sum, shown as double."""
    return F.sum(total).cast("double").alias(name)


@query("agg_events_by_type_date", f"""
SELECT type, strftime(event_at, '%Y-%m-%d') AS date, count(*) AS count FROM {RECORDER_EVENTS_SQL}
WHERE event_at >= TIMESTAMP '2024-01-10' GROUP BY ALL ORDER BY count DESC, type, date LIMIT 10""")
def agg_events_by_type_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(recorder_events(spark, sf_dir), Spec(("type", "date"), since=SINCE), events_domain())


@query("agg_multi_metric", f"""
SELECT model, count(*) AS count, CAST(coalesce(sum(input), 0) AS BIGINT) AS sum_input, CAST(coalesce(sum(output), 0) AS BIGINT) AS sum_output
FROM {USAGE_SQL} WHERE data_source = 'api' GROUP BY model ORDER BY count DESC, model NULLS LAST LIMIT 10""")
def agg_multi_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Spec(("model",), (Metric("count"), Metric("sum", "input"), Metric("sum", "output")), (Predicate("data_source", "=", "api"),))
    return aggregate(usage_ledger(spark, sf_dir), spec, cost_domain())


@query("agg_three_dims", f"""
SELECT client, type, confidence, count(*) AS count FROM {RECORDER_EVENTS_SQL}
GROUP BY ALL ORDER BY count DESC, client, type, confidence LIMIT 50""")
def agg_three_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(recorder_events(spark, sf_dir), Spec(("client", "type", "confidence"), limit=50), events_domain())


@query("agg_in_filter", f"""
SELECT hour, count(*) AS count FROM (SELECT strftime(event_at, '%Y-%m-%dT%H') AS hour FROM {RECORDER_EVENTS_SQL}
WHERE type IN ('error', 'purchase') AND client <> 'codex') GROUP BY hour ORDER BY count DESC, hour LIMIT 20""")
def agg_in_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Spec(("hour",), filters=(Predicate("type", "in", ("error", "purchase")), Predicate("client", "!=", "codex")), limit=20)
    return aggregate(recorder_events(spark, sf_dir), spec, events_domain())


@query("agg_total_other", f"""
WITH b AS (SELECT session, count(*) AS count FROM {RECORDER_EVENTS_SQL} GROUP BY session ORDER BY count DESC, session LIMIT 5),
t AS (SELECT count(*) AS total FROM events)
SELECT session, count, total, total AS rows_scanned, CAST(greatest(total - (SELECT sum(count) FROM b), 0) AS BIGINT) AS other_count FROM b, t""")
def agg_total_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_totals(recorder_events(spark, sf_dir), Spec(("session",), limit=5), events_domain())


@query("agg_cost_auto_partition", f"""
SELECT data_source, service_tier, CAST(coalesce(sum(output), 0) AS BIGINT) AS sum_output FROM {USAGE_SQL}
GROUP BY ALL ORDER BY sum_output DESC, data_source, service_tier NULLS LAST LIMIT 10""")
def agg_cost_auto_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(usage_ledger(spark, sf_dir), Spec(("service_tier",), (Metric("sum", "output"),)), cost_domain())


@query("workspace_split", f"""
SELECT split_part(substr(session_key, instr(session_key, ':') + 1), ':', 1) AS workspace, count(*) AS n FROM {SESSIONS_SQL} GROUP BY 1""")
def workspace_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.expr("substring(session_key, instr(session_key, ':') + 1)")
    return sessions(spark, sf_dir).groupBy(F.substring_index(rest, ":", 1).alias("workspace")).agg(F.count(F.lit(1)).alias("n"))


@query("status_counts", f"""
SELECT 'status' AS facet, status AS name, count(*) AS n FROM {SESSIONS_SQL} GROUP BY status UNION ALL
SELECT 'task_type', task_type, count(*) FROM {SESSIONS_SQL} GROUP BY task_type UNION ALL
SELECT 'model', model, count(*) FROM {SESSIONS_SQL} GROUP BY model UNION ALL
SELECT 'hold_state', hold_state, count(*) FROM {SESSIONS_SQL} GROUP BY hold_state""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by several facets in one pass: each row counts once for each facet."""
    facets = ("status", "task_type", "model", "hold_state")
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).alias("name")) for f in facets))).alias("p")
    return sessions(spark, sf_dir).select(pairs).groupBy("p.facet", "p.name").agg(F.count(F.lit(1)).alias("n"))


@query("family_stats", f"""
WITH f AS (SELECT logical_id, max(CASE WHEN status = 'F' THEN 3 WHEN status = 'O' THEN 2 ELSE 1 END) AS rank, count(*) AS n FROM {SESSIONS_SQL} GROUP BY 1)
SELECT CASE rank WHEN 3 THEN 'F' WHEN 2 THEN 'O' ELSE 'P' END AS status, count(*) AS families, CAST(sum(n) AS BIGINT) AS sessions FROM f GROUP BY 1""")
def family_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families by the status that takes precedence among their sessions."""
    rank = F.when(F.col("status") == "F", 3).when(F.col("status") == "O", 2).otherwise(1)
    families = sessions(spark, sf_dir).groupBy("logical_id").agg(F.max(rank).alias("rank"), F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("rank") == 3, "F").when(F.col("rank") == 2, "O").otherwise("P")
    return families.groupBy(name.alias("status")).agg(F.count(F.lit(1)).alias("families"), F.sum("n").alias("sessions"))


@query("dashboard_summary", f"""
SELECT count(*) AS sessions, count(DISTINCT logical_id) AS families, count(DISTINCT model) AS models, count(score) AS scored,
CAST(sum(cost) AS DOUBLE) AS total_cost, CAST(count(CASE WHEN model LIKE 'claude%' THEN 1 END) AS BIGINT) AS claude FROM {SESSIONS_SQL}""")
def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("sessions"), F.countDistinct("logical_id").alias("families"), F.countDistinct("model").alias("models"),
        F.count("score").alias("scored"), money(), F.count(F.when(F.col("model").startswith("claude"), 1)).alias("claude"),
    )


@query("resolve_rate_periods", f"""
WITH s AS (SELECT *, max(CAST(started_at AS DATE)) OVER () AS last FROM {SESSIONS_SQL})
SELECT CASE WHEN CAST(started_at AS DATE) > last - 90 THEN 'current' ELSE 'previous' END AS period, count(*) AS n,
CAST(count(CASE WHEN outcome = 'resolved' THEN 1 END) AS DOUBLE) / count(*) AS resolve_rate
FROM s WHERE CAST(started_at AS DATE) > last - 180 GROUP BY 1""")
def resolve_rate_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of the last 90 days and of the 90 days before."""
    s = sessions(spark, sf_dir).withColumn("day", F.to_date("started_at"))
    last = s.agg(F.max("day").alias("last"))
    s = s.join(F.broadcast(last), F.col("day") > F.date_sub("last", 180))
    period = F.when(F.col("day") > F.date_sub("last", 90), "current").otherwise("previous")
    n = F.count(F.lit(1))
    return s.groupBy(period.alias("period")).agg(n.alias("n"), (F.count(F.when(F.col("outcome") == "resolved", 1)) / n).alias("resolve_rate"))


@query("activity_daily", """SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS sessions FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")
def activity_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = recorder_events(spark, sf_dir).groupBy(F.to_date("event_at").alias("day"))
    return days.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("sessions")).orderBy(F.col("day").desc()).limit(30)


@query("activity_weekly", f"""SELECT strftime(started_at, '%Y-W%W') AS week, count(*) AS n FROM {SESSIONS_SQL} GROUP BY 1 ORDER BY 1 DESC LIMIT 12""")
def activity_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = sessions(spark, sf_dir).groupBy(week_of_year(F.col("started_at")).alias("week"))
    return weeks.agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("week").desc()).limit(12)


@query("heatmap_day_hour", """SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL""")
def heatmap_day_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = recorder_events(spark, sf_dir).withColumn("v", F.col("value").cast("decimal(18,2)"))
    return e.groupBy(F.to_date("event_at").alias("day"), F.hour("event_at").alias("hour")).agg(F.count(F.lit(1)).alias("n"), money("v", "total"))


@query("json_map_top_keys", """
WITH k AS (SELECT unnest(json_keys(props)) AS key, props FROM events)
SELECT key, CAST(sum(CAST(json_extract_string(props, '$.' || key) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM k GROUP BY key ORDER BY total DESC, key LIMIT 10""")
def json_map_top_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = recorder_events(spark, sf_dir).select(F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "v"))
    return parsed.groupBy("key").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n")).orderBy(F.col("total").desc(), "key").limit(10)


@query("json_extract_ratio", """
SELECT user_id AS session, CAST(sum(CASE WHEN event_type = 'view' THEN k ELSE 0 END) AS DOUBLE) / greatest(sum(CASE WHEN event_type = 'click' THEN k ELSE 0 END), 1) AS ratio
FROM (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def json_extract_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    of = lambda kind: F.sum(F.when(F.col("type") == kind, k).otherwise(0))
    return recorder_events(spark, sf_dir).groupBy("session").agg((of("view").cast("double") / F.greatest(of("click"), F.lit(1))).alias("ratio"))


@query("array_label_counts", """
WITH d AS (SELECT list_filter([CASE WHEN n_chars > 2000 THEN 'long' END, CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN contains(text, '|') THEN 'table' END], lambda x: x IS NOT NULL) AS badges FROM documents)
SELECT badge, count(*) AS n FROM (SELECT unnest(badges) AS badge FROM d) GROUP BY badge""")
def array_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    badges = F.array_compact(F.array(F.when(F.col("n_chars") > 2000, "long"), F.when(F.col("lang") == "en", "english"), F.when(F.contains("text", F.lit("|")), "table")))
    return table(spark, sf_dir, "documents").select(F.explode(badges).alias("badge")).groupBy("badge").agg(F.count(F.lit(1)).alias("n"))


@query("focus_nested_map", f"""
WITH p AS (SELECT model, task_type, count(*) AS n FROM {SESSIONS_SQL} GROUP BY ALL),
t AS (SELECT model, sum(n) AS total FROM p GROUP BY 1 ORDER BY total DESC, model LIMIT 3)
SELECT p.model, CAST(t.total AS BIGINT) AS total, string_agg(concat(task_type, '=', n), ',' ORDER BY task_type) AS tasks FROM p JOIN t USING (model) GROUP BY ALL""")
def focus_nested_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top models, each with its counts by task type: one grouped query instead of one for each."""
    pairs = sessions(spark, sf_dir).groupBy("model", "task_type").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.concat_ws("=", "task_type", "n")))
    nested = pairs.groupBy("model").agg(F.sum("n").alias("total"), F.concat_ws(",", entries).alias("tasks"))
    return nested.orderBy(F.col("total").desc(), "model").limit(3)


@query("effort_buckets", f"""
SELECT CASE WHEN cost < 50000 THEN '0-50k' WHEN cost < 150000 THEN '50-150k' WHEN cost < 300000 THEN '150-300k' ELSE '300k+' END AS bucket,
count(*) AS n, CAST(sum(cost) AS DOUBLE) AS total_cost FROM {SESSIONS_SQL} GROUP BY 1""")
def effort_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cost")
    bucket = F.when(c < 50000, "0-50k").when(c < 150000, "50-150k").when(c < 300000, "150-300k").otherwise("300k+")
    return sessions(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), money())


@query("model_effectiveness", f"""
SELECT model, count(*) AS n, CAST(sum(score) AS DOUBLE) / count(score) AS avg_score, CAST(count(CASE WHEN outcome = 'resolved' THEN 1 END) AS DOUBLE) / count(*) AS resolve_rate,
CAST(sum(cost) AS DOUBLE) AS total_cost FROM {SESSIONS_SQL} GROUP BY model""")
def model_effectiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return sessions(spark, sf_dir).groupBy("model").agg(
        n.alias("n"), (F.sum("score").cast("double") / F.count("score")).alias("avg_score"),
        (F.count(F.when(F.col("outcome") == "resolved", 1)) / n).alias("resolve_rate"), money(),
    )


@query("daily_trends", f"""
SELECT CAST(started_at AS DATE) AS day, count(*) AS n, CAST(sum(cost) AS DOUBLE) AS total_cost,
CAST(sum(date_diff('second', started_at, ended_at)) AS DOUBLE) / count(*) AS avg_seconds FROM {SESSIONS_SQL} GROUP BY 1""")
def daily_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = duration_seconds(F.col("started_at"), F.col("ended_at"))
    n = F.count(F.lit(1))
    return sessions(spark, sf_dir).groupBy(F.to_date("started_at").alias("day")).agg(n.alias("n"), money(), (F.sum(seconds).cast("double") / n).alias("avg_seconds"))


@query("cost_top", f"""SELECT model, CAST(sum(cost) AS DOUBLE) AS total_cost, count(*) AS n FROM {SESSIONS_SQL} GROUP BY model ORDER BY sum(cost) DESC, model LIMIT 10""")
def cost_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).groupBy("model").agg(money(), F.count(F.lit(1)).alias("n")).orderBy(F.col("total_cost").desc(), "model").limit(10)


@query("advisor_stats", f"""
SELECT model, task_type, count(*) AS n, count(CASE WHEN score <= 2 AND ended_at - started_at > INTERVAL 2 HOUR THEN 1 END) AS long_low,
count(CASE WHEN score >= 4 AND ended_at - started_at < INTERVAL 30 MINUTE THEN 1 END) AS short_high,
count(CASE WHEN model LIKE 'claude-opus%' AND score >= 4 AND task_type = '5-LOW' THEN 1 END) AS downgrade_candidates,
CAST(sum(interrupts) AS BIGINT) AS interrupts FROM {SESSIONS_SQL} GROUP BY ALL""")
def advisor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = duration_seconds(F.col("started_at"), F.col("ended_at"))
    many = lambda cond: F.count(F.when(cond, 1))
    return sessions(spark, sf_dir).groupBy("model", "task_type").agg(
        F.count(F.lit(1)).alias("n"), many((F.col("score") <= 2) & (seconds > 7200)).alias("long_low"),
        many((F.col("score") >= 4) & (seconds < 1800)).alias("short_high"),
        many(F.col("model").startswith("claude-opus") & (F.col("score") >= 4) & (F.col("task_type") == "5-LOW")).alias("downgrade_candidates"),
        F.sum("interrupts").alias("interrupts"),
    )


@query("advisor_best", f"""
WITH m AS (SELECT model, CAST(sum(score) AS DOUBLE) / count(score) AS quality, CAST(sum(cost) AS DOUBLE) / count(*) AS price FROM {SESSIONS_SQL} GROUP BY model)
SELECT (SELECT model FROM m ORDER BY quality DESC, model LIMIT 1) AS highest_quality, (SELECT model FROM m ORDER BY price, model LIMIT 1) AS most_efficient""")
def advisor_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of the highest mean score and the one of the lowest mean cost."""
    m = sessions(spark, sf_dir).groupBy("model").agg((F.sum("score").cast("double") / F.count("score")).alias("quality"), (F.sum("cost").cast("double") / F.count(F.lit(1))).alias("price"))
    best = F.min(F.struct((-F.col("quality")).alias("q"), "model"))["model"]
    return m.agg(best.alias("highest_quality"), F.min(F.struct("price", "model"))["model"].alias("most_efficient"))


@query("peak_hours", """SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, hour LIMIT 3""")
def peak_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = recorder_events(spark, sf_dir).groupBy(F.hour("event_at").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.orderBy(F.col("n").desc(), "hour").limit(3)


@query("low_days", """
WITH d AS (SELECT dayname(ts) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT day, n FROM d WHERE n * 7 < (SELECT sum(n) FROM d)""")
def low_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays with less than a seventh of all events."""
    days = recorder_events(spark, sf_dir).groupBy(F.date_format("event_at", "EEEE").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    total = days.agg(F.sum("n").alias("total"))
    return days.join(F.broadcast(total), F.col("n") * 7 < F.col("total")).select("day", "n")


@query("score_histogram", f"""SELECT coalesce(CAST(score AS VARCHAR), 'unscored') AS score, count(*) AS n, CAST(sum(CASE WHEN score >= 4 AND cost > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS high_value FROM {SESSIONS_SQL} GROUP BY 1""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.coalesce(F.col("score").cast("string"), F.lit("unscored"))
    high = F.count(F.when((F.col("score") >= 4) & (F.col("cost") > 100000), 1))
    return sessions(spark, sf_dir).groupBy(name.alias("score")).agg(F.count(F.lit(1)).alias("n"), high.alias("high_value"))


@query("avg_interrupts", f"""SELECT CAST(sum(interrupts) AS DOUBLE) / count(*) AS avg_interrupts, count(*) AS n FROM {SESSIONS_SQL} WHERE interrupts > 0""")
def avg_interrupts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return sessions(spark, sf_dir).where("interrupts > 0").agg((F.sum("interrupts").cast("double") / n).alias("avg_interrupts"), n.alias("n"))


BADGES = (*BADGE_OUTCOMES, None)
BADGE_SQL = "CASE session_id % 8 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BADGE_OUTCOMES)) + " END"


@query("outcome_distribution", f"""
WITH s AS (SELECT CASE WHEN session_id % 3 > 0 THEN outcome END AS judged, {BADGE_SQL} AS badge FROM {SESSIONS_SQL})
SELECT CASE WHEN judged IN {JUDGED_OUTCOMES} THEN judged WHEN judged IS NOT NULL THEN 'unknown' {" ".join(f"WHEN badge = '{b}' THEN '{o}'" for b, o in BADGE_OUTCOMES.items())} ELSE 'unscored' END AS outcome, count(*) AS n FROM s GROUP BY 1""")
def outcome_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by outcome as judged, else by badge (two of three sessions stand in for judged ones)."""
    judged = F.when(F.col("session_id") % 3 > 0, F.col("outcome"))
    badge = F.element_at(F.array(*map(F.lit, BADGES)), (F.col("session_id") % 8 + 1).cast("int"))
    return sessions(spark, sf_dir).groupBy(normalized_badge(judged, badge).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("model_effort_labels", f"""SELECT CASE WHEN session_id % 3 = 0 THEN concat(model, ' @ ', task_type) ELSE model END AS label, count(*) AS n FROM {SESSIONS_SQL} GROUP BY 1""")
def model_effort_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("session_id") % 3 == 0, F.concat_ws(" @ ", "model", "task_type")).otherwise(F.col("model"))
    return sessions(spark, sf_dir).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("duration_scatter", f"""SELECT session_id, date_diff('second', started_at, ended_at) AS seconds, score FROM {SESSIONS_SQL} WHERE score IS NOT NULL ORDER BY started_at DESC, session_id LIMIT 200""")
def duration_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir).where("score IS NOT NULL").orderBy(F.col("started_at").desc(), "session_id").limit(200)
    return s.select("session_id", duration_seconds(F.col("started_at"), F.col("ended_at")).alias("seconds"), "score")


@query("projects_listing", """
SELECT r.r_name AS source, n.n_name AS project, count(*) AS n, max(o.o_orderdate) AS latest FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL""")
def projects_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by project and source; the dimension tables' sizes let Spark broadcast them."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.groupBy(F.col("r_name").alias("source"), F.col("n_name").alias("project")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("latest"))


@query("queue_status", f"""
SELECT hold_state AS state, count(*) AS n, min(embargo_until) AS next_retry, CAST(sum(CASE WHEN score IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS waiting FROM {SESSIONS_SQL} GROUP BY 1""")
def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = F.count(F.when(F.col("score").isNull(), 1))
    return sessions(spark, sf_dir).groupBy(F.col("hold_state").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.min("embargo_until").alias("next_retry"), waiting.alias("waiting"))


@query("timeline_counts", f"""
SELECT session, count(*) AS events, count(CASE WHEN source = 'vendor' THEN 1 END) AS direct, count(CASE WHEN confidence = 'low' THEN 1 END) AS low_confidence,
count(CASE WHEN event_key IS NULL THEN 1 END) AS lossy FROM {RECORDER_EVENTS_SQL} GROUP BY session""")
def timeline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = lambda cond: F.count(F.when(cond, 1))
    return recorder_events(spark, sf_dir).groupBy("session").agg(
        F.count(F.lit(1)).alias("events"), many(F.col("source") == "vendor").alias("direct"),
        many(F.col("confidence") == "low").alias("low_confidence"), many(F.col("event_key").isNull()).alias("lossy"),
    )


@query("usage_stats", """
SELECT conv_id, count(*) AS messages, count(CASE WHEN role = 'user' THEN 1 END) AS user_messages, count(CASE WHEN role = 'assistant' THEN 1 END) AS assistant_messages,
CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id""")
def usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = lambda role: F.count(F.when(F.col("role") == role, 1))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), many("user").alias("user_messages"), many("assistant").alias("assistant_messages"), F.sum(F.length("text")).alias("chars")
    )


@query("snapshot_delta", f"""
WITH d AS (SELECT date_trunc('month', started_at) AS month, outcome, count(*) AS n FROM {SESSIONS_SQL} GROUP BY ALL),
r AS (SELECT month, outcome, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY month) AS rate FROM d)
SELECT CAST(month AS TIMESTAMP) AS month, outcome, rate, rate - lag(rate) OVER (PARTITION BY outcome ORDER BY month) AS delta FROM r""")
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's rates and their change since the month before."""
    counts = sessions(spark, sf_dir).groupBy(F.date_trunc("month", "started_at").alias("month"), "outcome").agg(F.count(F.lit(1)).alias("n"))
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("month"))
    rates = counts.select("month", "outcome", rate.alias("rate"))
    return rates.withColumn("delta", F.col("rate") - F.lag("rate").over(Window.partitionBy("outcome").orderBy("month")))


@query("client_health", f"""
SELECT client, count(DISTINCT session) AS sessions, count(DISTINCT type) AS types, array_to_string(list_sort(list_distinct(list(type)) ), ',') AS observed,
CASE WHEN count(DISTINCT CASE WHEN type NOT IN ('click', 'view', 'purchase') THEN type END) > 0 THEN 'drift' ELSE 'ok' END AS verdict FROM {RECORDER_EVENTS_SQL} GROUP BY client""")
def client_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that each client sends, against those that are known."""
    known = F.array(*map(F.lit, ("click", "view", "purchase")))
    seen = F.array_sort(F.collect_set("type"))
    return recorder_events(spark, sf_dir).groupBy("client").agg(
        F.countDistinct("session").alias("sessions"), F.countDistinct("type").alias("types"), F.array_join(seen, ",").alias("observed"),
        F.when(F.size(F.array_except(seen, known)) > 0, "drift").otherwise("ok").alias("verdict"),
    )


@query("theme_pivot", """
SELECT CAST(ts AS DATE) AS run, count(CASE WHEN event_type = 'click' THEN 1 END) AS click, count(CASE WHEN event_type = 'error' THEN 1 END) AS error,
count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchase, count(CASE WHEN event_type = 'signup' THEN 1 END) AS signup, count(CASE WHEN event_type = 'view' THEN 1 END) AS view FROM events GROUP BY 1""")
def theme_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    return recorder_events(spark, sf_dir).groupBy(F.to_date("event_at").alias("run")).pivot("type", kinds).agg(F.count(F.lit(1))).fillna(0, kinds)


@query("mode_recurrence", f"""
WITH m AS (SELECT DISTINCT session, type FROM {RECORDER_EVENTS_SQL} WHERE confidence IN ('high', 'medium')), n AS (SELECT count(DISTINCT session) AS n FROM m)
SELECT type AS mode, count(*) AS sessions, CAST(count(*) AS DOUBLE) / (SELECT n FROM n) AS rate FROM m GROUP BY type""")
def mode_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session counts once for each mode; rates over the sessions with any."""
    m = recorder_events(spark, sf_dir).where(F.col("confidence").isin("high", "medium")).select("session", "type").distinct()
    n = m.agg(F.countDistinct("session").alias("all"))
    counts = m.groupBy(F.col("type").alias("mode")).agg(F.count(F.lit(1)).alias("sessions"))
    return counts.crossJoin(F.broadcast(n)).select("mode", "sessions", (F.col("sessions") / F.col("all")).alias("rate"))


@query("focus_thresholds", f"""
SELECT task_type AS objective, count(*) AS sessions, count(DISTINCT CAST(started_at AS DATE)) AS days, count(DISTINCT logical_id) AS projects FROM {SESSIONS_SQL}
WHERE outcome = 'failed' GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT CAST(started_at AS DATE)) >= 2 AND count(DISTINCT logical_id) >= 2 ORDER BY sessions DESC, objective LIMIT 1""")
def focus_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objective that failed most often, in 3 sessions, on 2 days and in 2 projects at least."""
    failed = sessions(spark, sf_dir).where("outcome = 'failed'").groupBy(F.col("task_type").alias("objective"))
    counts = failed.agg(F.count(F.lit(1)).alias("sessions"), F.countDistinct(F.to_date("started_at")).alias("days"), F.countDistinct("logical_id").alias("projects"))
    return counts.where("sessions >= 3 AND days >= 2 AND projects >= 2").orderBy(F.col("sessions").desc(), "objective").limit(1)
