"""Decision queries: eligibility, exclusion reasons, holds, ranked selections, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.time import age_label, recency_weight
from tracelake.operators import gates, ranking, uploads
from tracelake.plans.registry import query, table
from tracelake.sources.adapters import MODELS, SESSIONS_SQL, sessions

#: The instant that time-dependent decisions are made at.
NOW_SQL = "TIMESTAMP '1999-06-01 00:00:00'"


def now() -> Column:
    return F.lit("1999-06-01 00:00:00").cast("timestamp_ntz")


# Sessions as the upload rules read them: the orders' keys stand in for what the given tables lack.
UPLOADS = {
    "source": "CASE session_id % 4 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'claude' ELSE concat('other', CAST(session_id % 3 AS STRING)) END", "project": "concat('proj', CAST(logical_id % 5 AS STRING))",
    "review_status": "CASE WHEN session_id % 97 = 0 THEN 'blocked' WHEN session_id % 13 = 1 THEN 'rejected' WHEN session_id % 5 = 2 THEN 'approved' WHEN session_id % 7 <> 3 THEN 'new' END",
    "hold_state": "CASE WHEN session_id % 89 = 3 THEN 'pending_review' WHEN session_id % 83 = 4 THEN 'embargoed' WHEN session_id % 79 = 5 THEN 'unheard of' WHEN session_id % 3 = 0 THEN 'released' ELSE 'auto_redacted' END",
    "ended_at": "CASE WHEN session_id % 31 <> 0 THEN ended_at END", "sealed": "session_id % 9 = 0", "revision": "concat('r', CAST(session_id % 3 AS STRING))", "active": "CASE WHEN session_id % 29 <> 0 THEN session_id % 37 <> 0 END",
    "has_blob": "session_id % 17 <> 5", "has_raw": "CASE WHEN session_id % 23 <> 0 THEN session_id % 19 <> 6 END",
}
UPLOAD_SCOPES = [("claude", "proj0"), ("claude", "proj1"), ("claude", "proj2"), ("codex", "proj1"), ("codex", "proj2"), ("codex", "proj3"), ("other0", "proj1")]
UPLOAD_MODES = [("claude", "stable_revision"), ("codex", "explicit_close")]
_uploads_sql = ", ".join(f"{v.replace('STRING', 'VARCHAR')} AS {k}" for k, v in UPLOADS.items())
UPLOADS_SQL = f"""
u AS (SELECT session_id, logical_id, score, ended_at + to_days(CAST(session_id % 400 AS INTEGER)) AS stable_since, CASE WHEN session_id % 2 = 0 THEN ended_at + to_days(CAST(session_id % 1500 AS INTEGER)) END AS embargo_until, {_uploads_sql} FROM {SESSIONS_SQL}),
s AS (SELECT * FROM u WHERE coalesce(active, true)),
h AS (SELECT logical_id, review_status, CASE WHEN hold_state = 'unheard of' THEN 'pending_review' WHEN hold_state = 'embargoed' AND embargo_until <= {NOW_SQL} THEN 'released' WHEN hold_state = 'embargoed' AND embargo_until IS NULL THEN 'pending_review' ELSE hold_state END AS hold FROM s),
f AS (SELECT logical_id, count(CASE WHEN review_status = 'blocked' THEN 1 END) > 0 AS blocked, count(CASE WHEN hold IN ('pending_review', 'embargoed') THEN 1 END) > 0 AS held FROM h GROUP BY 1),
d AS (SELECT l_orderkey AS session_id, concat('r', l_partkey % 3) AS revision, l_shipdate AS shared_at, l_linenumber AS share_id FROM lineitem WHERE l_linestatus = 'F' AND l_partkey % 10 < 3),
l AS (SELECT session_id, arg_max(revision, (shared_at, share_id)) AS latest, list(revision) AS shared FROM d GROUP BY 1),
scopes(source, project) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in UPLOAD_SCOPES)}), modes(source, mode) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in UPLOAD_MODES)}),
j AS (SELECT s.*, blocked, held, latest, shared, mode, {NOW_SQL} - INTERVAL 24 HOUR AS cutoff FROM s JOIN f USING (logical_id) LEFT JOIN l USING (session_id) LEFT JOIN modes USING (source)),
r AS (SELECT session_id, score, ended_at, mode, latest, CASE WHEN source NOT IN (SELECT source FROM scopes) THEN 'source_excluded' WHEN project NOT IN (SELECT project FROM scopes) THEN 'project_excluded'
 WHEN (source, project) NOT IN (SELECT (source, project) FROM scopes) THEN 'scope_pair_excluded' WHEN ended_at IS NULL THEN 'unsupported_unsettled' WHEN ended_at <= TIMESTAMP '1993-01-01' THEN 'pre_enrollment'
 WHEN mode IS NULL OR ended_at > {NOW_SQL} OR mode = 'stable_revision' AND NOT sealed AND (stable_since > cutoff OR ended_at > cutoff) THEN 'unsupported_unsettled'
 WHEN coalesce(list_contains(shared, revision), false) THEN 'already_shared' WHEN latest <> revision AND coalesce(review_status, 'new') <> 'approved' THEN 'changed_revision_needing_approval'
 WHEN blocked OR review_status IN ('blocked', 'rejected') THEN 'blocked_review_status' WHEN held THEN 'held_or_embargoed' WHEN NOT has_blob THEN 'missing_blob' WHEN has_raw IS NOT TRUE THEN 'raw_source_unavailable' ELSE 'eligible' END AS reason FROM j)"""


def upload_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir).select(
        "session_id", "logical_id", "score", F.expr("ended_at + make_dt_interval(CAST(session_id % 400 AS INT))").alias("stable_since"),
        F.expr("CASE WHEN session_id % 2 = 0 THEN ended_at + make_dt_interval(CAST(session_id % 1500 AS INT)) END").alias("embargo_until"), *(F.expr(v).alias(k) for k, v in UPLOADS.items()),
    )
    d = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F' AND l_partkey % 10 < 3")
    shares = d.select(F.col("l_orderkey").alias("session_id"), F.concat(F.lit("r"), (F.col("l_partkey") % 3).cast("string")).alias("revision"), F.col("l_shipdate").alias("shared_at"), F.col("l_shipdate").alias("created_at"), F.col("l_linenumber").alias("share_id"))
    scopes, modes = spark.createDataFrame(UPLOAD_SCOPES, "source string, project string"), spark.createDataFrame(UPLOAD_MODES, "source string, mode string")
    return uploads.upload_reasons(s, shares, scopes, modes, F.lit("1993-01-01").cast("timestamp_ntz"), now())


@query("exclusion_reasons", f"WITH {UPLOADS_SQL} SELECT reason, count(*) AS n FROM r GROUP BY reason")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sessions each reason keeps from being uploaded."""
    return upload_reasons(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("upload_candidates", f"""WITH {UPLOADS_SQL} SELECT session_id, score, ended_at, mode, latest IS NOT NULL AS updated, greatest(count(*) OVER () - 5, 0) AS deferred FROM r WHERE reason = 'eligible' ORDER BY score DESC NULLS LAST, ended_at DESC, session_id LIMIT 5""")
def upload_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.upload_selection(upload_reasons(spark, sf_dir))


@query("share_ready", f"""
WITH e AS (SELECT * FROM {SESSIONS_SQL} WHERE score >= 3 AND status <> 'P' AND hold_state IN ('auto_redacted', 'released') AND ended_at <= {NOW_SQL} - INTERVAL 1 DAY)
SELECT session_id, score, started_at FROM e ORDER BY score DESC, started_at DESC, session_id LIMIT 10""")
def share_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations: the best scored sessions that may be shared."""
    e = sessions(spark, sf_dir).where("score >= 3 AND status <> 'P' AND hold_state IN ('auto_redacted', 'released')").where(F.col("ended_at") <= now() - F.expr("INTERVAL 1 DAY"))
    return e.orderBy(F.col("score").desc(), F.col("started_at").desc(), "session_id").limit(10).select("session_id", "score", "started_at")


@query("release_gate", f"""
WITH q AS (SELECT DISTINCT l_orderkey AS session_id FROM lineitem WHERE l_orderkey % 3 = 0 UNION SELECT -1),
s AS (SELECT * FROM {SESSIONS_SQL})
SELECT q.session_id, CASE WHEN s.session_id IS NULL THEN 'missing' WHEN s.hold_state = 'pending_review' THEN 'pending' WHEN s.hold_state = 'embargoed' AND s.embargo_until > CAST({NOW_SQL} AS DATE) THEN 'embargoed' END AS blocker
FROM q LEFT JOIN s USING (session_id) WHERE blocker IS NOT NULL""")
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested sessions that may not be released, and why."""
    asked = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("session_id")).union(spark.range(1).select(F.lit(-1).cast("long"))).distinct()
    return gates.blockers(asked, sessions(spark, sf_dir), now())


@query("hold_effective", f"""
SELECT session_id, CASE WHEN hold_state = 'embargoed' AND embargo_until <= CAST({NOW_SQL} AS DATE) THEN 'released' ELSE hold_state END AS effective FROM {SESSIONS_SQL}""")
def hold_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).select("session_id", gates.effective_hold(now()).alias("effective"))


@query("rescore_selection", f"""
SELECT session_id, CASE WHEN score IS NULL THEN 'unscored' ELSE 'stale' END AS why FROM {SESSIONS_SQL} WHERE ended_at <= {NOW_SQL} - INTERVAL 180 SECOND AND (score IS NULL OR (score <= 2 AND interrupts >= 4)) ORDER BY score IS NOT NULL, started_at DESC, session_id LIMIT 25""")
def rescore_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled sessions to score: the unscored first, then those that grew past their score."""
    s = sessions(spark, sf_dir).where(F.col("ended_at") <= now() - F.expr("INTERVAL 180 SECOND")).where("score IS NULL OR (score <= 2 AND interrupts >= 4)")
    return s.orderBy(F.col("score").isNotNull(), F.col("started_at").desc(), "session_id").limit(25).select("session_id", F.when(F.col("score").isNull(), "unscored").otherwise("stale").alias("why"))


@query("queue_claim", f"""SELECT session_id, task_type FROM {SESSIONS_SQL} WHERE hold_state = 'auto_redacted' ORDER BY task_type, started_at, session_id LIMIT 1""")
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).where("hold_state = 'auto_redacted'").orderBy("task_type", "started_at", "session_id").limit(1).select("session_id", "task_type")


@query("upload_ranking", f"""SELECT session_id, score FROM {SESSIONS_SQL} WHERE hold_state <> 'pending_review' ORDER BY score IS NULL, score DESC, started_at DESC, session_id LIMIT 5""")
def upload_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir).where("hold_state <> 'pending_review'")
    return s.orderBy(F.col("score").desc_nulls_last(), F.col("started_at").desc(), "session_id").limit(5).select("session_id", "score")


@query("session_page", f"""SELECT session_id, score, started_at FROM {SESSIONS_SQL} WHERE status IN ('F', 'O') AND CAST(started_at AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' ORDER BY score DESC NULLS LAST, started_at DESC, session_id LIMIT 20 OFFSET 40""")
def session_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the session list: filters, order with nulls last, offset."""
    s = sessions(spark, sf_dir).where(F.col("status").isin("F", "O") & F.to_date("started_at").between("1996-01-01", "1998-12-31"))
    return s.orderBy(F.col("score").desc_nulls_last(), F.col("started_at").desc(), "session_id").offset(40).limit(20).select("session_id", "score", "started_at")


@query("week_failures", f"""
WITH f AS (SELECT session_id, score, started_at, count(*) OVER () AS total FROM {SESSIONS_SQL} WHERE outcome IN ('failed', 'abandoned') AND started_at >= {NOW_SQL} - INTERVAL 7 DAY AND started_at < {NOW_SQL})
SELECT session_id, score, greatest(total - 15, 0) AS dropped FROM f ORDER BY score DESC NULLS LAST, started_at DESC, session_id LIMIT 15""")
def week_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week's 15 first failures and how many more there are."""
    f = sessions(spark, sf_dir).where(F.col("outcome").isin("failed", "abandoned") & (F.col("started_at") >= now() - F.expr("INTERVAL 7 DAY")) & (F.col("started_at") < now()))
    total = f.agg(F.count(F.lit(1)).alias("total"))
    page = f.orderBy(F.col("score").desc_nulls_last(), F.col("started_at").desc(), "session_id").limit(15)
    return page.crossJoin(F.broadcast(total)).select("session_id", "score", F.greatest(F.col("total") - 15, F.lit(0).cast("long")).alias("dropped"))


@query("rank_candidates", f"""
WITH c AS (SELECT task_type, model, count(*) AS freq, max(started_at) AS latest, greatest(coalesce(max(score), 0), 0) AS impact, greatest(CAST(sum(interrupts) AS BIGINT), 0) AS corrections FROM {SESSIONS_SQL} WHERE outcome = 'failed' GROUP BY ALL)
SELECT task_type, model, round(pow(freq, 1.5::DOUBLE) * (1.0::DOUBLE + impact / 5.0::DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * least(greatest(1.0::DOUBLE / (1.0::DOUBLE + greatest(epoch({NOW_SQL} - latest) / 86400.0::DOUBLE, 0)), 0), 1)) * (1.0::DOUBLE + 0.5::DOUBLE * least(corrections, 2)), 6) AS rank FROM c ORDER BY 3 DESC, 1, 2 LIMIT 10""")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed work by frequency first, then severity, recency and corrections (scores and interrupts stand in for impact and corrections)."""
    c = sessions(spark, sf_dir).where("outcome = 'failed'").groupBy("task_type", "model").agg(
        F.count(F.lit(1)).alias("freq"), F.max("started_at").alias("latest"), F.max("score").alias("impact"), F.sum("interrupts").alias("corrections")
    )
    rank = ranking.candidate_rank(F.col("freq"), F.col("impact"), recency_weight(F.col("latest"), now()), F.col("corrections"))
    return c.select("task_type", "model", F.round(rank, 6).alias("rank")).orderBy(F.col("rank").desc(), "task_type", "model").limit(10)


@query("alternate_pools", f"""
WITH p AS (SELECT session_id, outcome, row_number() OVER (PARTITION BY outcome ORDER BY cost DESC, session_id) AS place FROM {SESSIONS_SQL} WHERE outcome IN ('failed', 'resolved'))
SELECT session_id, outcome, CAST(place AS INTEGER) AS place FROM p ORDER BY place, outcome LIMIT 15""")
def alternate_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir).where("outcome IN ('failed', 'resolved')")
    return ranking.alternating(s, "outcome", [F.col("cost").desc(), F.col("session_id")], 15).select("session_id", "outcome", "place")


@query("diversified_topn", f"""
WITH p AS (SELECT session_id, model, cost, row_number() OVER (PARTITION BY model ORDER BY cost DESC, session_id) AS p FROM {SESSIONS_SQL})
SELECT session_id, model FROM p ORDER BY p > 1, cost DESC, session_id LIMIT 12""")
def diversified_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most expensive session of each model, then the next ones whatever their model."""
    return ranking.diversified(sessions(spark, sf_dir), "model", [F.col("cost").desc(), F.col("session_id")], 12).select("session_id", "model")


@query("size_prefix", f"""
WITH r AS (SELECT logical_id, session_id, CAST(sum(interrupts + 1) OVER (PARTITION BY logical_id ORDER BY started_at DESC, session_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM {SESSIONS_SQL})
SELECT * FROM r WHERE running <= 20""")
def size_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir).select("logical_id", "session_id", "started_at", (F.col("interrupts") + 1).alias("size"))
    return ranking.within_budget(s, "logical_id", [F.col("started_at").desc(), F.col("session_id")], "size", 20).select("logical_id", "session_id", "running")


@query("union_latest_valid", f"""
SELECT logical_id, max(t) AS latest FROM (SELECT logical_id, started_at AS t FROM {SESSIONS_SQL} UNION ALL SELECT logical_id, ended_at FROM {SESSIONS_SQL} WHERE status <> 'P') GROUP BY 1""")
def union_latest_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir)
    both = s.select("logical_id", F.col("started_at").alias("t")).unionAll(s.where("status <> 'P'").select("logical_id", "ended_at"))
    return both.groupBy("logical_id").agg(F.max("t").alias("latest"))


@query("pool_difference", f"""
WITH f AS (SELECT DISTINCT logical_id FROM {SESSIONS_SQL} WHERE outcome = 'failed'), s AS (SELECT DISTINCT logical_id FROM {SESSIONS_SQL} WHERE outcome = 'resolved')
SELECT logical_id, 'failure' AS pool FROM f UNION ALL SELECT logical_id, 'success' FROM s WHERE logical_id NOT IN (SELECT logical_id FROM f)""")
def pool_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families in two pools; those that failed once are in the failure pool only."""
    s = sessions(spark, sf_dir)
    failed = s.where("outcome = 'failed'").select("logical_id").distinct()
    won = s.where("outcome = 'resolved'").select("logical_id").distinct().join(failed, "logical_id", "left_anti")
    return failed.withColumn("pool", F.lit("failure")).unionByName(won.withColumn("pool", F.lit("success")))


@query("semi_exact_shared", """SELECT o_orderkey AS session_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_linenumber = 1)""")
def semi_exact_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").select(F.col("l_orderkey").alias("session_id"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id")).join(shared, "session_id", "left_semi")


@query("anti_stale", """SELECT o_orderkey AS session_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)""")
def anti_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, (li["l_orderkey"] == o["o_orderkey"]) & (li["l_shipdate"] > o["o_orderdate"]), "left_anti").select(F.col("o_orderkey").alias("session_id"))


@query("bulk_status_update", f"""
WITH q AS (SELECT DISTINCT user_id * 101 AS session_id FROM events)
SELECT q.session_id, CASE WHEN s.session_id IS NULL THEN 'missing' ELSE 'updated' END AS result, CASE WHEN s.status <> 'F' THEN {NOW_SQL} ELSE s.ended_at END AS reviewed_at FROM q LEFT JOIN {SESSIONS_SQL} s USING (session_id)""")
def bulk_status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested ids as updated or missing, and the review time that results."""
    asked = table(spark, sf_dir, "events").select((F.col("user_id") * 101).alias("session_id")).distinct()
    s = sessions(spark, sf_dir).select("session_id", "status", "ended_at")
    joined = asked.join(s, "session_id", "left")
    reviewed = F.when(F.col("status") != "F", now()).otherwise(F.col("ended_at"))
    return joined.select("session_id", F.when(F.col("status").isNull(), "missing").otherwise("updated").alias("result"), reviewed.alias("reviewed_at"))


@query("revision_blockers", f"""
WITH s AS (SELECT session_id, logical_id, status, cost, lag(status) OVER w AS p_status, lag(cost) OVER w AS p_cost, lag(session_id) OVER w AS p_id FROM {SESSIONS_SQL} WINDOW w AS (PARTITION BY logical_id ORDER BY started_at, session_id))
SELECT session_id, CASE WHEN p_id IS NULL THEN 'first' WHEN p_status IS NOT DISTINCT FROM status AND p_cost IS NOT DISTINCT FROM cost THEN 'exact_shared' WHEN p_status IS DISTINCT FROM status THEN 'share_changed' ELSE 'predecessor' END AS blocker FROM s""")
def revision_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session against its predecessor in the family; comparisons treat nulls as values."""
    return gates.revision_blockers(sessions(spark, sf_dir))


@query("checkpoint_reconcile", f"""
SELECT logical_id, count(*) AS members, sha256(string_agg(CAST(session_id AS VARCHAR), ',' ORDER BY started_at, session_id)) AS revision, count(*) = count(DISTINCT started_at) AS ordered FROM {SESSIONS_SQL} GROUP BY 1""")
def checkpoint_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family's revision: the digest of its ordered members."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("started_at", "session_id"))), lambda x: x["session_id"].cast("string"))
    n = F.count(F.lit(1))
    return sessions(spark, sf_dir).groupBy("logical_id").agg(n.alias("members"), F.sha2(F.array_join(members, ","), 256).alias("revision"), (n == F.countDistinct("started_at")).alias("ordered"))


DUE_SQL = "TIMESTAMP '1998-07-01 00:00:00'"


@query("lesson_due", f"""
WITH s AS (SELECT model AS scope, *, 'proj' || logical_id % 5 AS project, CASE hold_state WHEN 'embargoed' THEN CASE WHEN embargo_until <= {DUE_SQL} THEN 'released' ELSE 'embargoed' END ELSE hold_state END AS hold, list_position({list(MODELS)}, model) - 1 AS i FROM {SESSIONS_SQL}),
a AS (SELECT scope, any_value(i) AS i, any_value(i) <> 6 AS enabled, max(CASE WHEN started_at <= {DUE_SQL} - to_days(CAST(i * 4 AS INTEGER)) THEN started_at END) AS last_activity, {DUE_SQL} - to_days(CAST(any_value(i) * 3 % 7 AS INTEGER)) AS last_nudged FROM s GROUP BY 1),
k AS (SELECT s.scope, score >= 3 OR outcome IN ('failed', 'abandoned') AS failed, row_number() OVER (PARTITION BY s.scope ORDER BY started_at DESC, session_id) AS n FROM s JOIN a ON a.scope = s.scope
  WHERE hold IN ('auto_redacted', 'released') AND status <> 'P' AND started_at <= {DUE_SQL} AND started_at > last_activity AND NOT (project = 'proj4' AND s.i % 2 = 1)),
c AS (SELECT scope, count(*) AS sessions, count(CASE WHEN failed THEN 1 END) AS failures FROM k WHERE n <= 25 GROUP BY 1),
b AS (SELECT a.scope, enabled, last_nudged, CASE WHEN last_activity IS NOT NULL THEN greatest(epoch_us({DUE_SQL}) - epoch_us(last_activity), 0) / 86400000000.0::DOUBLE END AS days, coalesce(sessions, 0) AS sessions, coalesce(failures, 0) AS failures FROM a LEFT JOIN c USING (scope))
SELECT scope, days, sessions, failures, sessions >= 25 AS saturated, CASE WHEN NOT enabled THEN 'nudge-not-enabled' WHEN days IS NULL THEN 'never-distilled' WHEN days < 7 THEN 'fresh' WHEN {DUE_SQL} - last_nudged < INTERVAL 3 DAY THEN 'cooldown'
  WHEN sessions < 5 THEN 'quiet' WHEN failures >= 3 OR sessions >= 25 OR days >= 14 THEN 'due' ELSE 'waiting' END AS decision FROM b""")
def lesson_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each model's lessons are due.

    A model's last session before a day of its own stands in for the last look at its lessons; every
    second model leaves one project out; sessions with status P are taken as segmented.
    """
    at = F.lit("1998-07-01").cast("timestamp_ntz")
    place = (F.array_position(F.array(*map(F.lit, MODELS)), F.col("model")) - 1).cast("int")
    s = sessions(spark, sf_dir).withColumns({
        "scope": F.col("model"), "i": place, "project": F.concat(F.lit("proj"), (F.col("logical_id") % 5).cast("string")), "review_status": F.when(F.col("status") == "P", "segmented"),
        "embargo_until": F.col("embargo_until").cast("timestamp_ntz"),
    })
    seen = F.max(F.when(F.col("started_at") <= at - F.make_dt_interval(F.col("i") * 4), F.col("started_at")))
    scopes = s.groupBy("scope", "i").agg(seen.alias("last_activity")).withColumns({"enabled": F.col("i") != 6, "last_nudged": at - F.make_dt_interval(F.col("i") * 3 % 7)})
    excluded = scopes.where("i % 2 = 1").select("scope", F.lit("proj4").alias("project"))
    return uploads.lessons_due(s, scopes, excluded, at)


@query("age_labels", f"""
SELECT label, count(*) AS n FROM (SELECT CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN concat(d, ' days ago') ELSE strftime(started_at, '%Y-%m-%d') END AS label
 FROM (SELECT started_at, date_diff('day', CAST(started_at AS DATE), CAST({NOW_SQL} AS DATE)) AS d FROM {SESSIONS_SQL} WHERE started_at < {NOW_SQL})) GROUP BY label""")
def age_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir).where(F.col("started_at") < now())
    return s.groupBy(age_label(F.col("started_at"), now()).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("downgrade_ratio", """
WITH p AS (SELECT p_brand, p_partkey, CAST(p_retailprice AS DOUBLE) AS price FROM part), m AS (SELECT p_brand, min(price) AS cheapest FROM p GROUP BY 1)
SELECT p_partkey, least(greatest(1.0::DOUBLE - cheapest / price, 0.0), 1.0) AS ratio FROM p JOIN m USING (p_brand)""")
def downgrade_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cheapest of the same family would save."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("price"))
    cheapest = p.groupBy("p_brand").agg(F.min("price").alias("cheapest"))
    ratio = F.least(F.greatest(1.0 - F.col("cheapest") / F.col("price"), F.lit(0.0)), F.lit(1.0))
    return p.join(cheapest, "p_brand").select("p_partkey", ratio.alias("ratio"))


@query("full_reprice", """
WITH u AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS fresh FROM lineitem GROUP BY 1)
SELECT o_orderkey AS session_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS stored, CAST(fresh AS DOUBLE) AS fresh FROM orders JOIN u ON l_orderkey = o_orderkey WHERE abs(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) - CAST(fresh AS DOUBLE)) >= 1e-9""")
def full_reprice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose stored cost differs from their ledger's."""
    u = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session_id")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("fresh"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("stored"))
    return o.join(u, "session_id").where(F.abs(F.col("stored") - F.col("fresh")) >= 1e-9)
