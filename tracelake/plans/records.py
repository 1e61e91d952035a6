"""Queries over stored records: identities, exports and imports, expansions, chunks, validation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions import text as rules
from tracelake.operators import sequence
from tracelake.plans.ordered import loop_runs
from tracelake.plans.registry import ORACLES, query, table
from tracelake.sources.adapters import RECORDER_EVENTS_SQL, SESSIONS_SQL, recorder_events, sessions

EMAIL = r"[A-Za-z0-9_.+-]{3,}@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("raw_fingerprint", "SELECT doc_id, concat('sha256:', sha256(text)) AS fingerprint, strlen(text) AS bytes FROM documents")
def raw_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.lit("sha256:"), F.sha2(F.col("text").cast("binary"), 256)).alias("fingerprint"), F.octet_length("text").cast("long").alias("bytes"))


@query("text_locations", """
SELECT conv_id, concat('messages[', row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, '].', f) AS location, CASE f WHEN 'role' THEN length(role) ELSE length(text) END AS chars FROM conversations, (VALUES ('role'), ('content')) x(f)""".replace("row_number()", "dense_rank()"))
def text_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text field of every message with its address."""
    n = F.row_number().over(sequence.by("conv_id", "turn")) - 1
    c = table(spark, sf_dir, "conversations").withColumn("n", n)
    fields = F.explode(F.array(F.struct(F.lit("role").alias("f"), F.length("role").alias("c")), F.struct(F.lit("content").alias("f"), F.length("text").alias("c")))).alias("x")
    return c.select("conv_id", "n", fields).select("conv_id", F.format_string("messages[%d].%s", "n", "x.f").alias("location"), F.col("x.c").cast("long").alias("chars"))


@query("finding_ids", f"""
WITH f AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{EMAIL}'))) AS entity FROM documents)
SELECT doc_id, sha256(concat_ws('|', 'email', doc_id, lower(entity))) AS finding_id FROM f""")
def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that stay the same from scan to scan."""
    f = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0)))).alias("entity"))
    return f.select("doc_id", F.sha2(F.concat_ws("|", F.lit("email"), "doc_id", F.lower("entity")), 256).alias("finding_id"))


# Name, pattern, group that is reported; parts of addresses that are none; findings of a scan that are shown.
QUICK_SCANS = (
    ("emails", r"[a-zA-Z0-9.+-]+@[a-zA-Z0-9.-]+\.[a-z]{2,}", 0),
    ("jwt_tokens", r"eyJ[A-Za-z0-9_-]{20,}", 0),
    ("api_keys", r"(ghp_|sk-|hf_)[A-Za-z0-9_-]{10,}", 1),
    ("ip_addresses", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0),
)
NO_EMAILS = ("noreply", "pytest.fixture", "mcp.tool", "mcp.resource", "server.tool", "tasks.loop", "github.com")
SHOWN = 20


@query("quick_pii_scan", f"""
WITH f AS ({" UNION ".join(f"SELECT '{n}' AS scan, unnest(regexp_extract_all(text, '{p}', {g})) AS found FROM documents" for n, p, g in QUICK_SCANS)})
SELECT scan, found FROM f WHERE scan <> 'emails' OR NOT ({" OR ".join(f"contains(found, '{e}')" for e in NO_EMAILS)}) QUALIFY row_number() OVER (PARTITION BY scan ORDER BY found) <= {SHOWN}""")
def quick_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first distinct findings of each quick scan."""

    def scanned(name: str, pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), lambda x: F.struct(F.lit(name).alias("scan"), x.alias("found")))

    every = F.concat(*(scanned(*s) for s in QUICK_SCANS))
    f = table(spark, sf_dir, "documents").select(F.explode(every).alias("f")).select("f.*").distinct()
    none = F.lit(False)
    for part in NO_EMAILS:
        none = none | F.contains("found", F.lit(part))
    nth = F.row_number().over(Window.partitionBy("scan").orderBy("found"))
    return f.where((F.col("scan") != "emails") | ~none).withColumn("n", nth).where(F.col("n") <= SHOWN).drop("n")


FOUND_SQL = f"(SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{EMAIL}'))) AS entity FROM documents)"


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0)))).alias("entity"))


@query("decision_log", f"SELECT doc_id, entity FROM {FOUND_SQL} WHERE lower(entity) NOT IN (SELECT lower(entity) FROM {FOUND_SQL} WHERE doc_id % 2 = 0)")
def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings whose entity has not been ignored in any document (even ids stand for ignored ones)."""
    f = found(spark, sf_dir).withColumn("e", F.lower("entity"))
    return f.join(f.where("doc_id % 2 = 0").select("e").distinct(), "e", "left_anti").select("doc_id", "entity")


@query("entity_status_expand", f"SELECT doc_id, entity FROM {FOUND_SQL} WHERE lower(entity) IN (SELECT lower(entity) FROM {FOUND_SQL} WHERE doc_id % 3 = 0)")
def entity_status_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status given to one finding, expanded to all of its entity."""
    f = found(spark, sf_dir).withColumn("e", F.lower("entity"))
    return f.join(f.where("doc_id % 3 = 0").select("e"), "e", "left_semi").select("doc_id", "entity")


@query("effort_score", f"""
SELECT session_id, round(greatest(least(0.3::DOUBLE * least(coalesce(date_diff('second', started_at, ended_at), 0) / 3600.0::DOUBLE, 1) + 0.3::DOUBLE * least(interrupts / 50.0::DOUBLE, 1) + 0.2::DOUBLE * least(CAST(cost AS DOUBLE) / 100000.0::DOUBLE, 1) + 0.2::DOUBLE * least(coalesce(score, 0) / 20.0::DOUBLE, 1), 1.0), 0.0), 9) AS effort FROM {SESSIONS_SQL}""")
def effort_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted shares of an hour, 50 tool calls, 100,000 tokens and 20 files, each capped.

    Interruptions, cost and score stand for tool calls, tokens and files.
    """
    from tracelake.functions.time import duration_seconds

    part = lambda c, most: F.least(c / F.lit(float(most)), F.lit(1.0))
    hour = part(F.coalesce(duration_seconds(F.col("started_at"), F.col("ended_at")), F.lit(0)), 3600)
    total = 0.3 * hour + 0.3 * part(F.col("interrupts"), 50) + 0.2 * part(F.col("cost").cast("double"), 100_000) + 0.2 * part(F.coalesce("score", F.lit(0)), 20)
    return sessions(spark, sf_dir).select("session_id", F.round(F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0)), 9).alias("effort"))


@query("bundle_digests", f"""
SELECT session, count(*) AS events, sha256(string_agg(concat(event_id, ':', type, ':', coalesce(event_key, '')), ',' ORDER BY event_at, event_id)) AS digest FROM {RECORDER_EVENTS_SQL} GROUP BY session""")
def bundle_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's events in canonical order, and the digest that its bundle carries."""
    line = F.concat_ws(":", "event_id", "type", F.coalesce("event_key", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("event_at", "event_id", line.alias("line"))))
    return recorder_events(spark, sf_dir).groupBy("session").agg(F.count(F.lit(1)).alias("events"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["line"]), ","), 256).alias("digest"))


@query("import_remap", f"""
WITH n AS (SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY event_at, event_id) AS local_id, lag(event_id) OVER (PARTITION BY session ORDER BY event_at, event_id) AS ref FROM {RECORDER_EVENTS_SQL})
SELECT a.session, a.local_id, b.local_id AS local_ref FROM n a LEFT JOIN n b ON b.session = a.session AND b.event_id = a.ref""")
def import_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of imported rows, turned from source ids into local ids by their key."""
    order = sequence.by("session", "event_at", "event_id")
    n = recorder_events(spark, sf_dir).select("session", "event_id", F.row_number().over(order).cast("long").alias("local_id"), F.lag("event_id").over(order).alias("ref"))
    ids = n.select(F.col("session").alias("s"), F.col("event_id").alias("e"), F.col("local_id").alias("local_ref"))
    return n.join(ids, (F.col("session") == F.col("s")) & (F.col("ref") == F.col("e")), "left").select("session", "local_id", "local_ref")


@query("incident_endpoints", f"""
WITH i AS ({ORACLES['loop_runs']}) SELECT i.session, i.count, f.event_at AS started_at, l.event_at AS ended_at FROM i JOIN {RECORDER_EVENTS_SQL} f ON f.event_id = i.first_event JOIN {RECORDER_EVENTS_SQL} l ON l.event_id = i.last_event""")
def incident_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with the times of their first and last events: two roles of one table."""
    e = recorder_events(spark, sf_dir)
    first = e.select(F.col("event_id").alias("first_event"), F.col("event_at").alias("started_at"))
    last = e.select(F.col("event_id").alias("last_event"), F.col("event_at").alias("ended_at"))
    return loop_runs(spark, sf_dir).join(first, "first_event").join(last, "last_event").select("session", "count", "started_at", "ended_at")


@query("parent_backfill", f"""
WITH s AS (SELECT session_id, session_key, CASE WHEN ends_with(session_key, ':sub') THEN left(session_key, length(session_key) - 4) END AS parent_key FROM {SESSIONS_SQL}),
p AS (SELECT session_key, min(session_id) AS id FROM s WHERE parent_key IS NULL GROUP BY 1)
SELECT s.session_id, p.id AS parent_id FROM s LEFT JOIN p ON p.session_key = s.parent_key""")
def parent_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents found by key after their children; children without one keep null."""
    s = sessions(spark, sf_dir).select("session_id", "session_key", F.when(F.col("session_key").endswith(":sub"), F.expr("left(session_key, length(session_key) - 4)")).alias("parent_key"))
    p = s.where("parent_key IS NULL").groupBy(F.col("session_key").alias("k")).agg(F.min("session_id").alias("parent_id"))
    return s.join(p, F.col("parent_key") == F.col("k"), "left").select("session_id", "parent_id")


CORRECTION_SQL = f"""(regexp_matches(head, $r${rules.CORRECTION_LEAD}$r$) OR regexp_matches(head, $r${rules.CORRECTION_STRONG}$r$) OR (regexp_matches(head, $r${rules.CORRECTION_INSTEAD}$r$) AND NOT regexp_matches(head, $r${rules.QUESTION_LEAD}$r$)))"""


@query("correction_turns", f"""
WITH t AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(text, $r${rules.SYSTEM_REMINDER}$r$, '', 'g'), '^\\s+|\\s+$', '', 'g') AS own, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
h AS (SELECT conv_id, turn, before, after, substr(CASE WHEN regexp_matches(own, $r${rules.NOT_BY_USER}$r$) THEN '' ELSE coalesce(own, '') END, 1, {rules.CORRECTION_HEAD}) AS head FROM t WHERE role = 'user' AND n > 1)
SELECT conv_id, turn, before, after, {CORRECTION_SQL} AS correction FROM h""")
def correction_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns after the first, whether they are corrections, with their neighbours."""
    order = sequence.by("conv_id", "turn")
    nth = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    correction = rules.is_correction(rules.by_user(F.col("text"))).alias("correction")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", correction, nth.alias("n"), F.lag("role").over(order).alias("before"), F.lead("role").over(order).alias("after"))
    return t.where((F.col("role") == "user") & (F.col("n") > 1)).select("conv_id", "turn", "before", "after", "correction")


@query("always_one_row", f"SELECT 1 AS one, (SELECT max(started_at) FROM {SESSIONS_SQL} WHERE status = 'none') AS latest")
def always_one_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row even where nothing qualifies: an aggregate without groups."""
    return sessions(spark, sf_dir).where("status = 'none'").agg(F.max("started_at").alias("latest")).select(F.lit(1).alias("one"), "latest")


@query("health_marks", f"SELECT type AS kind, count(*) AS n, max(event_id) AS high_water, max(event_at) AS latest FROM {RECORDER_EVENTS_SQL} GROUP BY type")
def health_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorder_events(spark, sf_dir).groupBy(F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("high_water"), F.max("event_at").alias("latest"))


@query("judge_validation", f"""
WITH j AS (SELECT session_id, CASE WHEN outcome IN ('resolved', 'partial', 'failed') THEN outcome ELSE 'unknown' END AS outcome, list_filter([status, task_type, 'x'], lambda v: v IN ('F', 'O', '1-URGENT', '2-HIGH')) AS labels, coalesce(least(greatest(score, 1), 5), 3) AS score FROM {SESSIONS_SQL})
SELECT outcome, array_to_string(labels, ',') AS labels, CAST(sum(score) AS BIGINT) AS total, count(*) AS n FROM j GROUP BY ALL""")
def judge_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results held to their enumerations: unknown labels go, scores are clamped, gaps get defaults."""
    known = F.array(*map(F.lit, ("F", "O", "1-URGENT", "2-HIGH")))
    outcome = F.when(F.col("outcome").isin("resolved", "partial", "failed"), F.col("outcome")).otherwise("unknown")
    labels = F.array_join(F.filter(F.array("status", "task_type", F.lit("x")), lambda v: F.array_contains(known, v)), ",")
    score = F.coalesce(F.least(F.greatest("score", F.lit(1)), F.lit(5)), F.lit(3))
    rows = sessions(spark, sf_dir).select(outcome.alias("outcome"), labels.alias("labels"), score.alias("score"))
    return rows.groupBy("outcome", "labels").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("n"))


@query("judge_chunks")
def judge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in chunks of at most 1500 characters that overlap by two messages.

    Prefix sums of the sizes tell by one search where a chunk from each message
    would end; those that are reached from the first message are kept.
    """

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = np.concatenate([[0], pdf.sort_values("turn")["size"].fillna(0).cumsum().to_numpy(np.int64)])
        n = len(ends) - 1
        stop = np.maximum(np.searchsorted(ends, ends[:-1] + 1500, side="right") - 1, np.arange(1, n + 1))
        starts = [0]
        while stop[starts[-1]] < n:
            starts.append(max(starts[-1] + 1, int(stop[starts[-1]]) - 2))
        out = [(first, int(stop[first]), int(ends[stop[first]] - ends[first])) for first in starts]
        frame = pd.DataFrame(out, columns=["first", "last", "chars"])
        frame.insert(0, "conv_id", pdf["conv_id"].iloc[0])
        return frame

    sizes = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return sizes.groupBy("conv_id").applyInPandas(chunk, "conv_id long, first long, last long, chars long")
