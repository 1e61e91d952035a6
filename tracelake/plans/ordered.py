"""Queries over ordered events, canonical views, trees and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions import money
from tracelake.operators import canonical, graph, sequence
from tracelake.plans.registry import query, table
from tracelake.sources.adapters import RECORDER_EVENTS_SQL, SESSIONS_SQL, USAGE_SQL, recorder_events, sessions, usage_ledger
from tracelake.streaming import checkpoints

RANK_SQL = "(CASE {0} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)"
OVERRIDES_SQL = f"""(SELECT session, event_key, 'corrected' AS type, confidence, event_id AS write_seq FROM {RECORDER_EVENTS_SQL} WHERE event_key IS NOT NULL AND event_id % 5 = 0
 UNION ALL SELECT session, concat(event_key, ':hook'), 'hook', confidence, event_id FROM {RECORDER_EVENTS_SQL} WHERE event_key IS NOT NULL AND event_id % 97 = 0)"""


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = recorder_events(spark, sf_dir).where("event_key IS NOT NULL")
    some = e.where("event_id % 5 = 0").select("session", "event_key", F.lit("corrected").alias("type"), "confidence", F.col("event_id").alias("write_seq"))
    hooks = e.where("event_id % 97 = 0").select("session", F.concat("event_key", F.lit(":hook")).alias("event_key"), F.lit("hook").alias("type"), "confidence", F.col("event_id").alias("write_seq"))
    return some.unionByName(hooks)


@query("canonical_first_per_key", f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY session, event_key ORDER BY event_at NULLS LAST, event_id) AS n FROM {RECORDER_EVENTS_SQL})
SELECT event_id, session, event_key, type, event_at FROM k WHERE n = 1 OR event_key IS NULL""")
def canonical_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.first_per_key(recorder_events(spark, sf_dir)).select("event_id", "session", "event_key", "type", "event_at")


@query("canonical_override_merge", f"""
WITH b AS (SELECT session, event_key, type, confidence, row_number() OVER (PARTITION BY session, event_key ORDER BY event_at NULLS LAST, event_id) AS n FROM {RECORDER_EVENTS_SQL}),
base AS (SELECT session, event_key, type, confidence FROM b WHERE n = 1 OR event_key IS NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY session, event_key ORDER BY {RANK_SQL.format("confidence")} DESC, write_seq) AS n FROM {OVERRIDES_SQL}),
j AS (SELECT coalesce(base.session, o.session) AS session, coalesce(base.event_key, o.event_key) AS event_key, base.type, base.confidence, base.session IS NULL AS hook,
 o.type AS o_type, o.confidence AS o_conf, o.type IS NOT NULL AND (base.session IS NULL OR {RANK_SQL.format("o.confidence")} >= {RANK_SQL.format("base.confidence")}) AS wins
 FROM base FULL OUTER JOIN (SELECT * FROM o WHERE n = 1) o ON base.session = o.session AND base.event_key = o.event_key)
SELECT session, event_key, CASE WHEN wins THEN o_type ELSE type END AS type, CASE WHEN wins THEN o_conf ELSE confidence END AS confidence,
 CASE WHEN hook THEN 'hook_only' WHEN wins THEN 'override' ELSE 'base' END AS origin FROM j""")
def canonical_override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.merged(recorder_events(spark, sf_dir), overrides(spark, sf_dir))


@query("capability_states", f"""
WITH m AS (SELECT c.client, t.type, NOT (c.client = 'codex' AND t.type = 'signup') AS supported
 FROM (VALUES ('claude'), ('codex'), ('openclaw')) c(client), (VALUES ('click'), ('error'), ('refund'), ('signup')) t(type)),
s AS (SELECT DISTINCT session, client FROM {RECORDER_EVENTS_SQL}), o AS (SELECT DISTINCT session, client, type FROM {RECORDER_EVENTS_SQL})
SELECT s.session, s.client, m.type, CASE WHEN o.session IS NOT NULL THEN 'observed' WHEN m.supported THEN 'absent' ELSE 'unsupported' END AS state
FROM s JOIN m USING (client) LEFT JOIN o ON o.session = s.session AND o.client = s.client AND o.type = m.type""")
def capability_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients, types = ("claude", "codex", "openclaw"), ("click", "error", "refund", "signup")
    rows = [(c, t, not (c == "codex" and t == "signup")) for c in clients for t in types]
    matrix = spark.createDataFrame(rows, "client string, type string, supported boolean")
    return canonical.capability_states(recorder_events(spark, sf_dir), matrix)


@query("asof_model_fill", f"""
SELECT session, event_id, last_value(CASE WHEN type = 'signup' THEN event_key END IGNORE NULLS) OVER (PARTITION BY session ORDER BY event_at, event_id ROWS UNBOUNDED PRECEDING) AS model FROM {RECORDER_EVENTS_SQL}""")
def asof_model_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = recorder_events(spark, sf_dir)
    return sequence.asof_fill(e, "session", ["event_at", "event_id"], F.when(F.col("type") == "signup", F.col("event_key")), "model").select("session", "event_id", "model")


PRICES_SQL = "(VALUES " + ", ".join(f"('{f}', '{t}', {', '.join(map(repr, map(float, v)))})" for (f, t), v in money.PRICES.items()) + ") p(family, tier, p_in, p_out, p_read, p_write, p_reason)"
NAMED_SQL = f"""(SELECT *, CASE WHEN model IS NULL THEN 'unknown' WHEN model LIKE '%claude%' THEN 'claude' WHEN model LIKE 'o3-mini%' THEN 'o' WHEN model LIKE '%gpt%' THEN 'gpt' WHEN model LIKE '%gemini%' THEN 'gemini' ELSE 'unknown' END AS family,
 CASE WHEN model IS NULL THEN '' WHEN model LIKE '%opus%' THEN 'opus' WHEN model LIKE '%sonnet%' THEN 'sonnet' WHEN model LIKE 'o3-mini%' THEN '3-mini' WHEN model LIKE 'gpt-5-mini%' THEN '5-mini' WHEN model LIKE 'gpt-4.1-mini%' THEN '4.1-mini' WHEN model LIKE '%gemini%pro%' THEN 'pro' ELSE model END AS tier FROM {USAGE_SQL})"""


@query("price_exact", f"""
SELECT session, turn, family, tier, (coalesce(input, 0) * p_in + coalesce(output, 0) * p_out + coalesce(cache_read, 0) * p_read + coalesce(cache_write, 0) * p_write + coalesce(reasoning, 0) * p_reason) / 1e6 AS cost_estimate
FROM {NAMED_SQL} LEFT JOIN {PRICES_SQL} USING (family, tier)""")
def price_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return money.exact_cost(usage_ledger(spark, sf_dir)).select("session", "turn", "family", "tier", "cost_estimate")


PREFIX_SQL = "(VALUES " + ", ".join(f"('{p}', {float(a)!r}, {float(b)!r})" for p, (a, b) in money.PREFIX_PRICES.items()) + ") p(prefix, p_in, p_out)"


@query("price_longest_prefix", f"""
WITH m AS (SELECT row_number() OVER () AS rid, session, turn, coalesce(input, 0) AS input, output, cache_read, regexp_replace(lower(model), '^.*/', '') AS name FROM {USAGE_SQL}),
r AS (SELECT m.*, p.prefix, p.p_in, p.p_out, row_number() OVER (PARTITION BY rid ORDER BY length(p.prefix) DESC NULLS LAST) AS n FROM m LEFT JOIN {PREFIX_SQL} ON starts_with(m.name, p.prefix))
SELECT session, turn, prefix, (input * p_in + output * p_out + cache_read * p_in * 0.1::DOUBLE + 0 * p_in * 1.25::DOUBLE) / 1e6 AS cost FROM r WHERE n = 1""")
def price_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    cost = money.session_cost(c("model"), c("input"), c("output"), c("cache_read"), c("cache_write"))
    return usage_ledger(spark, sf_dir).select("session", "turn", money.prefix_price(c("model"))["prefix"].alias("prefix"), cost.alias("cost"))


@query("anomaly_cache_collapse", f"""
WITH p AS (SELECT *, lag(data_source) OVER w AS p_source, lag(input) OVER w AS p_input, lag(cache_read) OVER w AS p_cache_read FROM {USAGE_SQL} WINDOW w AS (PARTITION BY session ORDER BY turn))
SELECT session, turn, p_cache_read, cache_read FROM p WHERE data_source = 'api' AND p_source = 'api' AND p_input > 0 AND abs(input - p_input) * 4 <= p_input AND p_cache_read > 0 AND cache_read * 2 <= p_cache_read""")
def anomaly_cache_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.cache_read_collapse(usage_ledger(spark, sf_dir))


@query("anomaly_input_spike", f"""
WITH p AS (SELECT session, turn, input, sum(input) OVER w AS before, count(input) OVER w AS n FROM {USAGE_SQL} WHERE data_source = 'api' AND input IS NOT NULL WINDOW w AS (PARTITION BY session ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT session, turn, input, CAST(before AS BIGINT) AS before FROM p WHERE n = 5 AND input * 5 > 3 * before""")
def anomaly_input_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.input_spike(usage_ledger(spark, sf_dir))


@query("anomaly_model_shift", f"""
WITH p AS (SELECT session, turn, model, lag(model) OVER (PARTITION BY session ORDER BY turn) AS previous FROM {USAGE_SQL} WHERE model IS NOT NULL)
SELECT * FROM p WHERE previous <> model""")
def anomaly_model_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.model_shift(usage_ledger(spark, sf_dir))


@query("anomaly_tier_shift", f"""
WITH p AS (SELECT session, turn, service_tier, model, lag(service_tier) OVER w AS previous, lag(model) OVER w AS p_model FROM {USAGE_SQL} WHERE service_tier IS NOT NULL WINDOW w AS (PARTITION BY session ORDER BY turn))
SELECT session, turn, previous, service_tier FROM p WHERE model IS NOT DISTINCT FROM p_model AND previous <> service_tier""")
def anomaly_tier_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.tier_shift(usage_ledger(spark, sf_dir))


@query("loop_runs", f"""
WITH r AS (SELECT session, event_at, event_id, CASE WHEN type IN ('click', 'view') THEN type END AS fp, type = 'signup' AS breaker FROM {RECORDER_EVENTS_SQL} WHERE type IN ('click', 'view', 'signup')),
m AS (SELECT *, CASE WHEN breaker OR coalesce(lag(breaker) OVER w, true) OR fp IS DISTINCT FROM lag(fp) OVER w THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY session ORDER BY event_at, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY event_at, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT session, fp AS fingerprint, count(*) AS count, arg_min(event_id, (event_at, event_id)) AS first_event, arg_max(event_id, (event_at, event_id)) AS last_event FROM i WHERE NOT breaker GROUP BY session, island, fp HAVING count(*) >= 3""")
def loop_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("type")
    return sequence.loop_runs(recorder_events(spark, sf_dir), F.when(kind.isin("click", "view"), kind), kind == "signup")


@query("tool_result_pairing", """
WITH c AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT u.conv_id, u.turn AS call_turn, a.turn AS result_turn, row_number() OVER (PARTITION BY u.conv_id, u.turn ORDER BY a.turn) AS n
 FROM (SELECT * FROM c WHERE role = 'user') u JOIN (SELECT * FROM c WHERE role = 'assistant') a ON u.conv_id = a.conv_id AND a.turn > u.turn)
SELECT conv_id, call_turn, result_turn FROM p WHERE n = 1""")
def tool_result_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call's first later result, by one window over the session."""
    w = sequence.by("conv_id", "turn").rowsBetween(1, Window.unboundedFollowing)
    later = F.first(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(w)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", F.col("turn").alias("call_turn"), later.alias("result_turn"))
    return rows.where("role = 'user' AND result_turn IS NOT NULL").drop("role")


@query("turn_numbers", """SELECT conv_id, turn AS message, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn FROM conversations""")
def turn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("message"), "role")
    return sequence.turn_numbers(c, "conv_id", ["message"], F.col("role") == "user").drop("role")


@query("turn_groups", """
WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations)
SELECT conv_id, CAST(g AS BIGINT) AS turn, count(*) AS messages, string_agg(role, '>' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM t GROUP BY conv_id, g""")
def turn_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumnRenamed("turn", "message")
    turns = sequence.turn_numbers(c, "conv_id", ["message"], F.col("role") == "user").groupBy("conv_id", "turn")
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message", "role"))), lambda x: x["role"]), ">")
    return turns.agg(F.count(F.lit(1)).alias("messages"), roles.alias("roles"), F.sum(F.length("text")).alias("chars"))


@query("time_gap_segments", f"""
WITH g AS (SELECT *, CASE WHEN event_at - lag(event_at) OVER (PARTITION BY session ORDER BY event_at, event_id) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM {RECORDER_EVENTS_SQL}),
n AS (SELECT *, sum(s) OVER (PARTITION BY session ORDER BY event_at, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM g)
SELECT session, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(event_at) AS started, max(event_at) AS ended FROM n GROUP BY session, segment""")
def time_gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = sequence.gap_segments(recorder_events(spark, sf_dir), "session", "event_at", 6 * 3600, "event_id")
    return marked.groupBy("session", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("event_at").alias("started"), F.max("event_at").alias("ended"))


@query("session_window_gap", f"""
WITH g AS (SELECT *, CASE WHEN event_at - lag(event_at) OVER (PARTITION BY session ORDER BY event_at, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM {RECORDER_EVENTS_SQL}),
n AS (SELECT *, sum(s) OVER (PARTITION BY session ORDER BY event_at, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM g)
SELECT session, min(event_at) AS started, max(event_at) + INTERVAL 1 HOUR AS closes, count(*) AS n FROM n GROUP BY session, segment""")
def session_window_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that close after an idle hour."""
    idle = F.session_window("event_at", "1 hour").alias("w")
    return recorder_events(spark, sf_dir).groupBy("session", idle).agg(F.count(F.lit(1)).alias("n")).select("session", F.col("w.start").alias("started"), F.col("w.end").alias("closes"), "n")


@query("mode_shift", """
WITH t AS (SELECT conv_id, turn, role, text, count(CASE WHEN role = 'user' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS exchange FROM conversations),
e AS (SELECT conv_id, exchange, min(turn) AS turn, coalesce(CAST(sum(CASE WHEN role = 'assistant' THEN length(text) // 100 END) AS BIGINT), 0) AS tools FROM t WHERE exchange > 0 GROUP BY ALL),
p AS (SELECT conv_id, exchange, turn, CASE WHEN tools = 0 THEN 'qa' WHEN tools <= 3 THEN 'light' ELSE 'heavy' END AS mode FROM e)
SELECT conv_id, turn, previous, mode FROM (SELECT *, lag(mode) OVER (PARTITION BY conv_id ORDER BY exchange) AS previous FROM p) WHERE previous <> mode""")
def mode_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges, from a user's turn to the next, whose use of tools differs from the one before.

    Every 100 characters of the assistant stand in for a call.
    """
    calls = F.when(F.col("role") == "assistant", F.floor(F.length("text") / 100))
    exchange = F.count(F.when(F.col("role") == "user", 1)).over(sequence.by("conv_id", "turn"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", exchange.alias("exchange"), calls.alias("calls")).where("exchange > 0")
    e = t.groupBy("conv_id", "exchange").agg(F.min("turn").alias("turn"), F.coalesce(F.sum("calls"), F.lit(0)).alias("tools"))
    e = e.withColumn("mode", sequence.tool_mode(F.col("tools")))
    return e.select("conv_id", "turn", F.lag("mode").over(sequence.by("conv_id", "exchange")).alias("previous"), "mode").where("previous <> mode")


@query("boundary_agreement", """
WITH r AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, event_type FROM events),
b AS (SELECT session, idx, CASE event_type WHEN 'signup' THEN 90 WHEN 'purchase' THEN 80 WHEN 'error' THEN 60 WHEN 'click' THEN 50 ELSE 0 END AS w FROM r),
s AS (SELECT a.session, a.idx, max(b.w) AS most, count(DISTINCT b.w) AS n FROM b a JOIN b ON a.session = b.session AND abs(a.idx - b.idx) <= 2 AND b.w > 0 WHERE a.w > 0 GROUP BY a.session, a.idx)
SELECT session, idx, CAST(CASE WHEN n >= 3 THEN 95 WHEN n = 2 THEN most + 10 ELSE most END AS BIGINT) AS score FROM s""")
def boundary_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of boundaries in hundredths, from the signals within two places: three or more
    give 95, two the stronger one's weight and 10, one its weight (four kinds of events stand for the signals)."""
    order = sequence.by("session", "event_at", "event_id")
    kind = F.col("type")
    weight = F.when(kind == "signup", 90).when(kind == "purchase", 80).when(kind == "error", 60).when(kind == "click", 50).otherwise(0)
    rows = recorder_events(spark, sf_dir).select("session", F.row_number().over(order).cast("long").alias("idx"), weight.alias("w"), "event_at", "event_id")
    near = F.filter(F.collect_set("w").over(order.rowsBetween(-2, 2)), lambda x: x > 0)
    score = F.when(F.size("near") >= 3, 95).when(F.size("near") == 2, F.array_max("near") + 10).otherwise(F.array_max("near"))
    return rows.withColumn("near", near).where("w > 0").select("session", "idx", score.cast("long").alias("score"))


@query("token_deltas", f"""
WITH c AS (SELECT session, turn, CAST(sum(output) OVER (PARTITION BY session ORDER BY turn) AS BIGINT) AS total FROM {USAGE_SQL})
SELECT session, turn, total, greatest(total - coalesce(lag(total) OVER (PARTITION BY session ORDER BY turn), 0), 0) AS delta FROM c""")
def token_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = F.sum("output").over(sequence.by("session", "turn"))
    totals = usage_ledger(spark, sf_dir).select("session", "turn", running.alias("total"))
    return sequence.token_deltas(totals, "session", ["turn"], "total")


@query("append_checkpoints")
def append_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations closed at the first whole turn beyond 4 messages or 800 bytes (tested against the rule; trace_checkpoints has SQL)."""
    c = table(spark, sf_dir, "conversations")
    messages = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("place"), "role", F.octet_length("text").alias("text_bytes"), F.lit(0).alias("raw_start"), F.lit(0).alias("raw_end"))
    return checkpoints.segments(messages, checkpoints.Limits(messages=4, text_bytes=800)).drop("raw_start", "raw_end")


@query("error_recovery", f"""
WITH r AS (SELECT session, client AS tool, event_at, event_id, type = 'purchase' AS ok, type = 'error' AND event_id % 3 <> 0 AS bad FROM {RECORDER_EVENTS_SQL}),
g AS (SELECT *, coalesce(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY session, tool ORDER BY event_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM r)
SELECT session, tool, arg_max(event_id, (event_at, event_id)) FILTER (WHERE bad) AS error_event, max(event_id) FILTER (WHERE ok) AS success_event FROM g GROUP BY session, tool, grp
HAVING count(*) FILTER (WHERE bad) > 0 AND count(*) FILTER (WHERE ok) > 0""")
def error_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = recorder_events(spark, sf_dir).withColumn("tool", F.col("client"))
    return sequence.error_recovery(e, F.col("type") == "purchase", (F.col("type") == "error") & (F.col("event_id") % 3 != 0))


@query("late_third_errors", f"""
WITH n AS (SELECT session, type, row_number() OVER (PARTITION BY session ORDER BY event_at, event_id) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM {RECORDER_EVENTS_SQL})
SELECT session, count(CASE WHEN type = 'error' AND i >= n * 2 // 3 THEN 1 END) AS late_errors, count(CASE WHEN type = 'error' AND i < n // 3 THEN 1 END) AS early_errors FROM n GROUP BY session""")
def late_third_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = sequence.by("session", "event_at", "event_id")
    rows = recorder_events(spark, sf_dir).select("session", "type", (F.row_number().over(order) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("session")).alias("n"))
    many = lambda cond: F.count(F.when((F.col("type") == "error") & F.expr(cond), 1))
    return rows.groupBy("session").agg(many("i >= n * 2 div 3").alias("late_errors"), many("i < n div 3").alias("early_errors"))


@query("last_speaker", """SELECT conv_id, arg_max(role, turn) AS last_role, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def last_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("last_turn"))


@query("range_contiguity", """
WITH p AS (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS previous FROM lineitem)
SELECT l_orderkey, bool_and(previous IS NULL OR previous + 1 = l_linenumber) AS contiguous, count(*) AS segments FROM p GROUP BY l_orderkey""")
def range_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = sequence.by("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lag("l_linenumber").over(order).alias("previous"))
    return p.groupBy("l_orderkey").agg(F.bool_and(F.expr("previous IS NULL OR previous + 1 = l_linenumber")).alias("contiguous"), F.count(F.lit(1)).alias("segments"))


@query("latest_revision", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY logical_id ORDER BY started_at DESC, session_id DESC) AS n FROM {SESSIONS_SQL} WHERE status = 'F')
SELECT logical_id, session_id, started_at FROM r WHERE n = 1""")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest successful revision of each family, without sorting families."""
    done = sessions(spark, sf_dir).where("status = 'F'").groupBy("logical_id").agg(F.max(F.struct("started_at", "session_id")).alias("m"))
    return done.select("logical_id", "m.session_id", "m.started_at")


@query("family_rep_and_rollup", f"""
SELECT logical_id, arg_min(session_id, (started_at, session_id)) AS representative, count(*) AS segments, CAST(sum(cost) AS DOUBLE) AS total_cost,
CASE WHEN bool_or(hold_state = 'pending_review') THEN 'pending_review' WHEN bool_or(hold_state = 'embargoed') THEN 'embargoed' WHEN bool_or(hold_state = 'released') THEN 'released' ELSE 'auto_redacted' END AS hold_state,
max(embargo_until) AS embargo_until FROM {SESSIONS_SQL} GROUP BY logical_id""")
def family_rep_and_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family control: pending review before embargo (the latest) before release before automatic."""
    has = lambda state: F.bool_or(F.col("hold_state") == state)
    state = F.when(has("pending_review"), "pending_review").when(has("embargoed"), "embargoed").when(has("released"), "released").otherwise("auto_redacted")
    return sessions(spark, sf_dir).groupBy("logical_id").agg(
        F.min_by("session_id", F.struct("started_at", "session_id")).alias("representative"), F.count(F.lit(1)).alias("segments"),
        F.sum("cost").cast("double").alias("total_cost"), state.alias("hold_state"), F.max("embargo_until").alias("embargo_until"),
    )


@query("backfill_sequence", f"""SELECT event_id, row_number() OVER (PARTITION BY session ORDER BY event_at, event_id) + (SELECT max(event_id) FROM events) AS write_seq FROM {RECORDER_EVENTS_SQL} WHERE event_key IS NULL""")
def backfill_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence numbers for rows that have none, on top of the largest one."""
    e = recorder_events(spark, sf_dir)
    top = e.agg(F.max("event_id").alias("top"))
    n = F.row_number().over(sequence.by("session", "event_at", "event_id"))
    return e.where("event_key IS NULL").crossJoin(F.broadcast(top)).select("event_id", (n + F.col("top")).alias("write_seq"))


@query("recursive_tree", """
WITH RECURSIVE n AS (SELECT DISTINCT user_id AS node, CASE WHEN user_id > 3 THEN user_id // 2 END AS parent FROM events),
k AS (SELECT n.node, p.node AS parent FROM n LEFT JOIN n p ON p.node = n.parent),
t(node, root, depth) AS (SELECT node, node, 0 FROM k WHERE parent IS NULL UNION ALL SELECT k.node, t.root, t.depth + 1 FROM k JOIN t ON k.parent = t.node)
SELECT node, root, depth FROM t""")
def recursive_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "events").select(F.col("user_id").alias("node")).distinct()
    return graph.tree_depths(nodes.withColumn("parent", F.when(F.col("node") > 3, F.expr("node div 2"))))


@query("interval_children", f"""
WITH s AS (SELECT session_id AS id, logical_id % 50 AS project, started_at AS started, ended_at AS ended FROM {SESSIONS_SQL}),
p AS (SELECT c.id AS child, p.id AS parent, row_number() OVER (PARTITION BY c.id ORDER BY p.started, p.id) AS n FROM s c JOIN s p ON c.project = p.project AND c.id <> p.id AND c.started BETWEEN p.started AND p.ended AND (p.started, p.id) < (c.started, c.id))
SELECT child, parent FROM p WHERE n = 1""")
def interval_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir).select(F.col("session_id").alias("id"), (F.col("logical_id") % 50).alias("project"), F.col("started_at").alias("started"), F.col("ended_at").alias("ended"))
    return graph.interval_children(s, "project")


@query("workspace_switch", f"""
WITH k AS (SELECT logical_id, session_id, started_at, substr(session_key, instr(session_key, ':') + 1) AS workspace FROM {SESSIONS_SQL}),
p AS (SELECT *, lag(workspace) OVER (PARTITION BY logical_id ORDER BY started_at, session_id) AS previous FROM k)
SELECT logical_id, session_id, previous, workspace FROM p WHERE previous <> workspace""")
def workspace_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = sessions(spark, sf_dir).select("logical_id", "session_id", "started_at", F.expr("substring(session_key, instr(session_key, ':') + 1)").alias("workspace"))
    p = k.withColumn("previous", F.lag("workspace").over(sequence.by("logical_id", "started_at", "session_id")))
    return p.where("previous <> workspace").drop("started_at")
