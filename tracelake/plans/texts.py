"""Queries over texts: rules, redaction, titles, search, signatures, similarity."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import text as rules
from tracelake.operators import findings, index, lessons, ranking, redaction, search
from tracelake.plans.registry import query, table
from tracelake.sources.adapters import SESSIONS_SQL, sessions
from tracelake.sources.store import scratch

#: Rules that both engines' regular expressions can express, with spans left out.
SHARED = (("email", r"[A-Za-z0-9_.+-]{3,}@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"), ("token", r"[0-9a-f]{32,}", "[TOKEN]"), ("number", r"[0-9]{5,}", "[NUMBER]"))


def redacted_sql(text: str) -> str:
    for _, pattern, name in SHARED:
        text = f"regexp_replace({text}, '{pattern}', '{name}', 'g')"
    return text


@query("findings_scan")
def findings_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings with their spans (tested rule by rule; SQL has no match positions)."""
    return findings.scan(table(spark, sf_dir, "documents"))


@query("findings_rule_counts", " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS docs, CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '{p}') HAVING count(*) > 0" for n, p, _ in SHARED))
def findings_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and matches of several rules in one pass."""
    per = F.array(*(F.struct(F.lit(n).alias("rule"), F.regexp_count("text", F.lit(p)).alias("n")) for n, p, _ in SHARED))
    rows = table(spark, sf_dir, "documents").select(F.explode(per).alias("r")).where("r.n > 0")
    return rows.groupBy("r.rule").agg(F.count(F.lit(1)).alias("docs"), F.sum("r.n").alias("n"))


@query("findings_entity_dedupe", f"""
WITH f AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{SHARED[0][1]}'))) AS entity FROM documents)
SELECT entity, count(*) AS n, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM f GROUP BY entity""")
def findings_entity_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.explode(F.regexp_extract_all("text", F.lit(SHARED[0][1]), F.lit(0))).alias("entity")
    f = table(spark, sf_dir, "documents").select("doc_id", found).withColumn("entity", F.lower("entity"))
    return f.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"))


@query("findings_summary")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by rule and type, with the number of documents (rules run in Python)."""
    f = findings.scan(table(spark, sf_dir, "documents"))
    return f.groupBy("rule", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("allowlist_match", f"""
WITH f AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{SHARED[0][1]}'))) AS entity, 'email' AS entity_type FROM documents),
a AS (SELECT entity, CASE WHEN (length(entity) + k) % 2 = 0 THEN 'email' END AS entity_type, (7 * length(entity) + 5 * k) % 11 AS added_at, concat(entity, '#', k) AS entry_id FROM (SELECT DISTINCT entity FROM f), (VALUES (1), (2), (3)) k(k)),
t AS (SELECT entity, entity_type, arg_min(entry_id, (added_at, entry_id)) AS id FROM a GROUP BY ALL)
SELECT f.doc_id, f.entity, coalesce(x.id, y.id) AS entry_id FROM f LEFT JOIN t x ON x.entity = f.entity AND x.entity_type = f.entity_type LEFT JOIN t y ON y.entity = f.entity AND y.entity_type IS NULL""")
def allowlist_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their allow-list entry; entries stand in for three of each entity."""
    found = F.explode(F.regexp_extract_all("text", F.lit(SHARED[0][1]), F.lit(0))).alias("entity")
    f = table(spark, sf_dir, "documents").select("doc_id", found).withColumn("entity", F.lower("entity")).distinct().withColumn("entity_type", F.lit("email"))
    three = f.select("entity").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3))))
    kind = F.when((F.length("entity") + F.col("k")) % 2 == 0, "email").alias("entity_type")
    added = ((7 * F.length("entity") + 5 * F.col("k")) % 11).alias("added_at")
    entries = three.select("entity", kind, added, F.concat_ws("#", "entity", F.col("k").cast("string")).alias("entry_id"))
    return findings.allowed(f, entries).select("doc_id", "entity", "entry_id")


@query("redact_text", f"SELECT doc_id, sha256({redacted_sql('text')}) AS digest FROM documents")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = tuple((n, p, name.replace("[", "\\[")) for n, p, name in SHARED)
    done = findings.redacted(table(spark, sf_dir, "documents"), steps)
    return done.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("anonymize_paths", """
SELECT user_id AS session, regexp_replace(concat('open /home/user', user_id, '/src then /home/user', user_id, '2/x by user', user_id, '.'), concat('(^|[^A-Za-z0-9_])user', user_id, '($|[^A-Za-z0-9_])'), '\\1[USER]\\2', 'g') AS line
FROM (SELECT DISTINCT user_id FROM events)""")
def anonymize_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and names of all users: whole names only, whatever they stand next to."""
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("session")).distinct()
    u = F.concat(F.lit("user"), F.col("session").cast("string"))
    line = F.concat(F.lit("open /home/"), u, F.lit("/src then /home/"), u, F.lit("2/x by "), u, F.lit("."))
    return s.select("session", rules.anonymized(line, u).alias("line"))


def normalized_sql(text: str) -> str:
    # In a dialect without lookaround and possessive repeats.
    path = rf"([\"'`]){rules.QUOTED_PATH}([\"'`])|{rules.PATH_ROOT}(?:{rules.PATH_CHARS}+(?: {rules.PATH_CHARS}+)*/)*{rules.PATH_CHARS}+"
    for pattern, name in rules.OUTCOME_STEPS:
        pattern, name = (path, "$1<PATH>$2") if pattern == rules.HOME_PATH else (pattern, name)
        text = f"regexp_replace({text}, $r${pattern}$r$, '{name.replace('$', chr(92))}', 'g')"
    return f"trim({text})"


@query("outcome_normalized", f"""
SELECT conv_id, turn, {normalized_sql("concat('at 2026-04-21T10:00:0', turn % 10, 'Z [', 1000 + turn, '] pid ', turn, ' /home/', role, '/x y  ', text)")} AS line FROM conversations""")
def outcome_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts behind a head with volatile parts, which become placeholders; runs of blanks collapse."""
    head = F.format_string("at 2026-04-21T10:00:0%dZ [%d] pid %d /home/%s/x y  ", F.col("turn") % 10, F.col("turn") + 1000, "turn", "role")
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", rules.normalized_outcome(F.concat(head, F.coalesce("text", F.lit("")))).alias("line"))


@query("anonymize_texts")
def anonymize_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts, with each row's own name replaced (tested on a small fixture; DuckDB has no lookbehind)."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", rules.anonymized(F.col("text"), F.col("role")).alias("text"))


@query("outcome_texts")
def outcome_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with their volatile parts normalised (tested on a small fixture)."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", rules.normalized_outcome(F.col("text")).alias("line"))


@query("high_entropy_tokens")
def high_entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 15 distinct long strings by Shannon entropy (tested against a plain formula)."""
    return findings.top_entropy(table(spark, sf_dir, "documents"), "doc_id", "text", r"[A-Za-z0-9+/_=-]{20,}", 15)


def task_sql(first: str, rest: str) -> str:
    rows = ", ".join(f"(2 * len(regexp_extract_all({first}, $r$(?i)\\b(?:{w})\\b$r$)) + len(regexp_extract_all({rest}, $r$(?i)\\b(?:{w})\\b$r$)), -{i}, '{k}')" for i, (k, w) in enumerate(rules.TASK_WORDS.items()))
    return f"list_max([{rows}])"


@query("task_type", f"""
WITH b AS (SELECT item_id, {task_sql("'please fix the build ' || item_id % 3", "CASE item_id % 4 WHEN 0 THEN 'add tests and add docs' WHEN 1 THEN 'explain what is broken' WHEN 2 THEN 'migrate and upgrade, then deploy docker' ELSE text END")} AS m FROM benchmark)
SELECT item_id, CASE WHEN m[1] > 0 THEN m[3] ELSE 'general' END AS task_type FROM b""")
def task_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("item_id")
    first = F.concat(F.lit("please fix the build "), (n % 3).cast("string"))
    rest = F.when(n % 4 == 0, "add tests and add docs").when(n % 4 == 1, "explain what is broken").when(n % 4 == 2, "migrate and upgrade, then deploy docker").otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", rules.task_type(first, rest).alias("task_type"))


def signal_sql(signals: tuple, text: str = "text") -> str:
    """The signals in a dialect without lookbehind: failed builds are taken out first."""
    parts = []
    for s in signals:
        one = [(re.sub(r"^\(\?<!BUILD\\s\)", "", p), f"regexp_replace({text}, 'BUILD\\sFAILED', ' ', 'g')" if p.startswith("(?<!") else text) for p in ((s,) if isinstance(s, str) else s)]
        parts.append("(" + " AND ".join(f"regexp_matches({t}, $r${p}$r$)" for p, t in one) + ")")
    return "(" + " OR ".join(parts) + ")"


@query("outcome_badge", f"""
WITH m AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN text END AS text, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT conv_id, count(text) AS outputs, bool_or({signal_sql(rules.TESTS_FAILED)}) AS tests_failed, bool_or({signal_sql(rules.BUILD_FAILED)}) AS build_failed, bool_or({signal_sql(rules.TESTS_PASSED)}) AS tests_passed,
 bool_or(idx >= n * 2 // 3 AND regexp_matches(text, $r${rules.LATE_ERROR}$r$)) AS late, arg_max(role, turn) FILTER (role IN ('user', 'assistant')) AS last FROM m GROUP BY conv_id)
SELECT conv_id, CASE WHEN outputs = 0 THEN 'analysis_only' WHEN tests_failed THEN 'tests_failed' WHEN build_failed THEN 'build_failed' WHEN tests_passed THEN 'tests_passed' WHEN last = 'user' THEN 'partial' WHEN late THEN 'errored' ELSE 'completed' END AS badge FROM g""")
def outcome_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A badge from the signals in outputs, by priority, else from late errors and the last speaker.

    Turns of the assistant stand in for outputs of tools.
    """
    from pyspark.sql.window import Window

    own = Window.partitionBy("conv_id")
    output = F.when(F.col("role") == "assistant", F.col("text"))
    m = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", output.isNotNull().alias("output"),
        *(rules.signalled(output, s).alias(n) for n, s in (("tests_failed", rules.TESTS_FAILED), ("build_failed", rules.BUILD_FAILED), ("tests_passed", rules.TESTS_PASSED), ("late", (rules.LATE_ERROR,)))),
        (F.row_number().over(own.orderBy("turn")) - 1).alias("idx"), F.count(F.lit(1)).over(own).alias("n"),
    )
    any_of = {n: F.bool_or(F.col(n)) for n in ("tests_failed", "build_failed", "tests_passed")}
    badge = F.when(~F.bool_or("output"), "analysis_only")
    for name, found in any_of.items():
        badge = badge.when(found, name)
    last = F.max(F.when(F.col("role").isin("user", "assistant"), F.struct("turn", "role")))["role"]
    badge = badge.when(last == "user", "partial").when(F.bool_or(F.col("late") & (F.col("idx") >= F.floor(F.col("n") * 2 / 3))), "errored")
    return m.groupBy("conv_id").agg(badge.otherwise("completed").alias("badge"))


@query("sensitivity", f"""
WITH l AS (SELECT doc_id, text, regexp_replace(text, '[^A-Za-z\\s]', '.', 'g') AS letters FROM documents),
n AS (SELECT doc_id, len(regexp_extract_all(text, '{SHARED[1][1]}')) AS secrets, len(regexp_extract_all(text, $r${rules.PRIVATE_URL}$r$)) AS urls,
 len(list_filter(regexp_extract_all(letters, '\\b[A-Z][a-z]{{1,7}}\\s+[A-Z][a-z]{{1,12}}\\b'), lambda x: NOT regexp_matches(x, $r${rules.NO_NAMES}$r$))) AS names FROM l)
SELECT doc_id, round(least(least(secrets * 0.3::DOUBLE, 1) + least(names * 0.1::DOUBLE, 1) + least(urls * 0.15::DOUBLE, 1), 1), 9) AS sensitivity FROM n""")
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk from 0 to 1 by counts of secrets, names and private addresses (long hex strings stand in for secrets)."""
    text = F.col("text")
    score = rules.sensitivity(F.regexp_count(text, F.lit(SHARED[1][1])), F.size(rules.proper_names(text)), F.regexp_count(text, F.lit(rules.PRIVATE_URL)))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(score, 9).alias("sensitivity"))


LINES_SQL = r"list_transform(string_split_regex(text, '\r\n|\n|\r'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"
COLLAPSED_SQL = rf"list_transform({LINES_SQL}, lambda x: lower(regexp_replace(regexp_replace(regexp_replace(x, '(?:/[\p{{L}}\p{{N}}_.\-]+){{2,}}', '<path>', 'g'), '\b[0-9a-f]{{7,}}\b', '<hex>', 'g'), '\p{{Nd}}+', '#', 'g')))"
SIGNATURE_SQL = f"""substr(list_filter({COLLAPSED_SQL}, lambda x: length(x) >= 8 AND x NOT IN {rules.GENERIC_ERRORS} AND NOT starts_with(x, '{rules.ERROR_PREAMBLES[0]}') AND NOT starts_with(x, '{rules.ERROR_PREAMBLES[1]}'))[1], 1, 110)"""


@query("error_signature_clusters", f"""
WITH g AS (SELECT doc_id, coalesce({SIGNATURE_SQL}, '') AS signature FROM documents WHERE NOT regexp_matches(text, $r${rules.HUMAN_REJECTION}$r$) AND NOT regexp_matches(text, $r${rules.BENIGN_ERROR}$r$))
SELECT signature, count(DISTINCT doc_id) AS sessions, count(*) AS n FROM g WHERE signature <> '' GROUP BY signature HAVING count(DISTINCT doc_id) >= 2 ORDER BY sessions DESC, signature LIMIT 3""")
def error_signature_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signatures that most sessions share; documents stand in for outputs of sessions."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    # Exploded, as a filter on the column would work it out twice.
    signature = F.explode(F.array_remove(F.array(rules.teachable_error(F.col("text"))), "")).alias("signature")
    g = d.select("doc_id", signature).groupBy("signature")
    counts = g.agg(F.countDistinct("doc_id").alias("sessions"), F.count(F.lit(1)).alias("n"))
    return counts.where("sessions >= 2").orderBy(F.col("sessions").desc(), "signature").limit(3)


TERMS_SQL = "list_filter(string_split_regex(lower(strip_accents({0})), '[^\\p{{L}}\\p{{N}}_-]+'), lambda x: x <> '')"


def bm25_sql(terms: tuple[str, ...], limit: int, where: str = "TRUE") -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(CASE WHEN tf{i} > 0 THEN 1 END) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"greatest(ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / (total::DOUBLE / n)))" for i in range(len(terms)))
    some = " + ".join(f"tf{i}" for i in range(len(terms)))
    return f"""WITH w AS (SELECT doc_id, {TERMS_SQL.format('text')} AS t FROM documents), r AS (SELECT doc_id, t, len(t) AS length, {tf} FROM w), s AS (SELECT count(*) AS n, sum(length) AS total, {df} FROM r)
SELECT doc_id, round(-({part}), 9) AS score FROM r, s WHERE {some} > 0 AND {where} ORDER BY -({part}), doc_id LIMIT {limit}"""


_INDEXES: dict[tuple[str, str], str] = {}


def indexed(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the index over all documents; built once for an application and its input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        folder = scratch(spark, "index")
        index.update(spark, folder, table(spark, sf_dir, "documents"), 0)
        _INDEXES[key] = folder
    return _INDEXES[key]


def found(spark: SparkSession, sf_dir: str, what: index.Expression, limit: int) -> DataFrame:
    hits = index.search(spark, indexed(spark, sf_dir), index.Request(what, limit))
    return hits.select("doc_id", F.round("score", 9).alias("score"))


@query("search_bm25", bm25_sql(("the", "ndst", "that"), 50))
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, index.Some(tuple(map(index.word, ("the", "ndst", "that")))), 50)


@query("search_all_none", bm25_sql(("of", "that"), 20, "list_contains(t, 'of') AND list_contains(t, 'that') AND NOT list_contains(t, 'is')"))
def search_all_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, index.Without(index.Every((index.word("of"), index.word("that"))), index.word("is")), 20)


@query("search_phrase", f"""SELECT doc_id FROM (SELECT doc_id, concat(' ', array_to_string({TERMS_SQL.format('text')}, ' '), ' ') AS t FROM documents) WHERE contains(t, ' of the ')""")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.matched(spark, indexed(spark, sf_dir), index.Phrase(("of", "the"))).select("doc_id")


@query("search_near", f"""
WITH w AS (SELECT doc_id, {TERMS_SQL.format('text')} AS t FROM documents),
p AS (SELECT doc_id, list_filter(range(1, len(t) + 1), lambda i: t[i] = 'with') AS a, list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the') AS b FROM w)
SELECT doc_id FROM p WHERE len(list_filter(a, lambda x: len(list_filter(b, lambda y: greatest(x, y) - x - 1 <= 3 AND greatest(x, y) - y - 2 <= 3)) > 0)) > 0""")
def search_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term and a phrase with at most three terms between them."""
    return index.matched(spark, indexed(spark, sf_dir), index.Near((index.word("with"), index.Phrase(("of", "the"))), 3)).select("doc_id")


@query("search_prefix", f"""
WITH w AS (SELECT doc_id, {TERMS_SQL.format('text')} AS t FROM documents)
SELECT doc_id FROM w WHERE (len(list_filter(t, lambda x: starts_with(x, 'pro'))) > 0 OR list_contains(t, 'ndst')) AND NOT len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND starts_with(t[i + 1], 'th'))) > 0""")
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms by their start, one of them the last of a phrase, in a nested expression."""
    what = index.Without(index.Some((index.Phrase(("pro",), True), index.word("ndst"))), index.Phrase(("of", "th"), True))
    return index.matched(spark, indexed(spark, sf_dir), what).select("doc_id")


@query("search_gated", f"""
WITH w AS (SELECT doc_id, lang, {TERMS_SQL.format('text')} AS t FROM documents), r AS (SELECT doc_id, lang, len(t) AS length, len(list_filter(t, lambda x: x = 'that')) AS f FROM w),
s AS (SELECT count(*) AS n, sum(length) AS total, count(CASE WHEN f > 0 THEN 1 END) AS df FROM r),
m AS (SELECT doc_id, -greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / (total::DOUBLE / n))) AS score FROM r, s
      WHERE f > 0 AND lang IN ('en', 'fr') AND doc_id NOT IN (SELECT session_id FROM {SESSIONS_SQL} WHERE hold_state = 'pending_review' OR hold_state = 'embargoed' AND (embargo_until IS NULL OR embargo_until > DATE '1995-06-01')))
SELECT doc_id, round(score, 9) AS score, (SELECT count(*) FROM m) AS rows_matched FROM m ORDER BY m.score, doc_id LIMIT 25""")
def search_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search among the events of some clients whose sessions are not held; documents stand for events, orders for their sessions."""
    held = sessions(spark, sf_dir).select(F.col("session_id").alias("session"), "hold_state", "embargo_until")
    events = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("session"), F.col("lang").alias("client"))
    among = index.allowed(events, "doc_id", F.lit("1995-06-01").cast("date"), held, client=("en", "fr"))
    hits = index.search(spark, indexed(spark, sf_dir), index.Request(index.word("that"), 25), among)
    return hits.select("doc_id", F.round("score", 9).alias("score"), "rows_matched")


@query("search_upkeep", bm25_sql(("the", "that"), 40).replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE substr(text, 1, length(text) // 2) END AS text FROM documents WHERE doc_id % 7 <> 0)"))
def search_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that got half of each text, then the whole of every second one, then lost every seventh document, and was compacted."""
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "index")
    index.update(spark, folder, docs.withColumn("text", F.expr("substr(text, 1, length(text) div 2)")), 0)
    index.update(spark, folder, docs.where("doc_id % 2 = 0"), 1)
    index.update(spark, folder, docs.limit(0), 2, deleted=docs.where("doc_id % 7 = 0").select("doc_id"))
    index.compact(spark, folder, f"{folder}/compact")
    hits = index.search(spark, f"{folder}/compact", index.Request(index.Some((index.word("the"), index.word("that"))), 40))
    return hits.select("doc_id", F.round("score", 9).alias("score"))


@query("search_gate", f"""
SELECT session_id, hold_state FROM {SESSIONS_SQL} WHERE hold_state IN ('auto_redacted', 'released') OR (hold_state = 'embargoed' AND embargo_until <= DATE '1998-01-01')""")
def search_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).where(search.visible(None, F.lit("1998-01-01").cast("date"))).select("session_id", "hold_state")


@query("search_family", f"""
WITH h AS (SELECT doc_id % 40 AS family, doc_id, len(list_filter({TERMS_SQL.format('text')}, lambda x: x = 'that')) AS hits FROM documents)
SELECT family, max(hits) AS best, arg_max(doc_id, (hits, -doc_id)) AS doc_id FROM h WHERE hits > 0 GROUP BY family ORDER BY best DESC, family LIMIT 10""")
def search_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit of each family, then a page of families."""
    hits = F.size(F.filter(rules.tokens(F.col("text")), lambda x: x == "that")).cast("long")
    h = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("family"), "doc_id", hits.alias("hits")).where("hits > 0")
    best = F.max_by("doc_id", F.struct("hits", (-F.col("doc_id")).alias("d")))
    return h.groupBy("family").agg(F.max("hits").alias("best"), best.alias("doc_id")).orderBy(F.col("best").desc(), "family").limit(10)


@query("search_snippet", f"""
WITH w AS (SELECT doc_id, {TERMS_SQL.format('text')} AS t FROM documents), p AS (SELECT doc_id, t, list_position(t, 'that') AS hit FROM w)
SELECT doc_id, array_to_string(list_slice(t, greatest(hit - 5, 1), greatest(hit - 5, 1) + 10), ' ') AS snippet FROM p WHERE hit > 0""")
def search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", search.snippet(F.col("text"), "that").alias("snippet"))
    return docs.where("snippet IS NOT NULL")


@query("display_titles", """
WITH l AS (SELECT doc_id, trim(regexp_replace(regexp_extract(trim(text), '^([^\\n]*)', 1), '^[#>*\\-\\s]+', '')) AS line FROM documents)
SELECT doc_id, CASE WHEN length(line) <= 80 THEN line ELSE concat(regexp_extract(substr(line, 1, 79), '^(.*)\\s', 1), '…') END AS title FROM l""")
def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", rules.display_title(F.col("text")).alias("title"))


CATEGORY_SQL = "CASE " + " ".join(f"WHEN program IN {tuple(p.split())} THEN '{c}'" for c, p in rules.COMMAND_CATEGORIES.items()) + " ELSE 'other' END"


@query("command_categories", rf"""
WITH c AS (SELECT regexp_replace(list_last(string_split_regex(unnest(string_split_regex(text, '[.\n]')), '\s*&&\s*|\s*;\s*|\s*\|\|\s*')), '^\s+|\s+$', '', 'g') AS command FROM conversations),
p AS (SELECT regexp_extract(command, '^(?:\S*/)?([^\s/]*)', 1) AS program FROM c)
SELECT {CATEGORY_SQL} AS category, count(*) AS n FROM p GROUP BY 1""")
def command_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What commands run; sentences and lines of conversations stand in for command lines."""
    c = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", r"[.\n]")).alias("command"))
    return c.groupBy(rules.command_category(F.col("command")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


WORDS_SQL = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z]+'), lambda x: length(x) > 3))"


@query("jaccard_pairs", f"""
WITH k AS (SELECT item_id, unnest({WORDS_SQL.format('text')}) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM k GROUP BY 1),
p AS (SELECT a.item_id AS x, b.item_id AS y, count(*) AS o FROM k a JOIN k b ON a.w = b.w AND a.item_id < b.item_id GROUP BY ALL)
SELECT x, y, CAST(o AS DOUBLE) / (nx.n + ny.n - o) AS jaccard FROM p JOIN n nx ON nx.item_id = x JOIN n ny ON ny.item_id = y WHERE o * 100 >= 3 * (nx.n + ny.n - o)""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lessons whose keyword sets have Jaccard similarity 0.03 or more (a handful of lessons, by shared words)."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 3))
    return ranking.keyword_pairs(table(spark, sf_dir, "benchmark").select("item_id", words.alias("words")), "item_id", 0.03)


def benchmark_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as lessons: titles of a few words, guidance of the text and of every second one's neighbour."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    n = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select((n * 2).alias("place"), words.alias("words"), F.col("text").alias("guidance"), (n % 2).alias("parity"))
    again = rows.select((F.col("place") + 1).alias("place"), F.reverse("words").alias("words"), F.array_join(F.slice("words", 1, 12), " ").alias("guidance"), "parity")
    kind, fresh = F.when(F.col("parity") == 0, "do").otherwise("avoid"), F.col("place") % 3 == 0
    null = F.lit(None).cast("string")
    return rows.unionByName(again).select("place", kind.alias("kind"), null.alias("taxonomy"), null.alias("origin"), F.array_join(F.slice("words", 1, 4), " ").alias("title"), "guidance", null.alias("trigger"), fresh.alias("fresh"), F.length("guidance").cast("double").alias("support"))


@query("lesson_pairs")
def lesson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lessons that teach the same (tested against a comparison of all pairs)."""
    return lessons.alike(benchmark_lessons(spark, sf_dir))


@query("near_duplicate_collapse")
def near_duplicate_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lessons in rank order, one of those alike (tested against a plain walk)."""
    rows, folder = benchmark_lessons(spark, sf_dir), scratch(spark, "lessons")

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return lessons.selected(rows, lessons.alike(rows), write)


@query("support_decay", f"""SELECT session_id, interrupts * pow(0.5::DOUBLE, date_diff('day', CAST(started_at AS DATE), DATE '2001-01-01') / 30.0::DOUBLE) > 1e-9 AS alive, date_diff('day', CAST(started_at AS DATE), DATE '2001-01-01') AS age FROM {SESSIONS_SQL}""")
def support_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support that halves every 30 days."""
    age = F.datediff(F.lit("2001-01-01").cast("date"), F.to_date("started_at")).cast("long")
    s = sessions(spark, sf_dir).select("session_id", "interrupts", age.alias("age"))
    return s.select("session_id", (ranking.decayed(F.col("interrupts"), F.col("age")) > 1e-9).alias("alive"), "age")


@query("priority_max", """
WITH n AS (SELECT conv_id, turn, role, length(text) > 400 AS heavy, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
p AS (SELECT conv_id, turn AS idx, 1000 AS p FROM n WHERE turn = 0 OR turn = last UNION ALL SELECT conv_id, turn + d, 850 FROM n, (VALUES (-1), (0), (1)) x(d) WHERE heavy UNION ALL SELECT conv_id, turn, 350 FROM n WHERE role = 'user' UNION ALL SELECT conv_id, turn, 100 FROM n WHERE turn % 2 = 0),
m AS (SELECT conv_id, idx, max(p) AS priority FROM p GROUP BY ALL)
SELECT m.conv_id, idx, CAST(priority AS INTEGER) AS priority FROM m JOIN n ON n.conv_id = m.conv_id AND n.turn = m.idx""")
def priority_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment's highest priority: ends, neighbours of heavy ones, user turns, every second."""
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "conversations")
    heavy = (F.length("text") > 400).cast("int")
    near = F.max(heavy).over(Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-1, 1))
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    rows = c.select("conv_id", F.col("turn").alias("idx"), "role", near.alias("near"), last.alias("last"))
    p = F.when((F.col("idx") == 0) | (F.col("idx") == F.col("last")), 1000).when(F.col("near") == 1, 850).when(F.col("role") == "user", 350).when(F.col("idx") % 2 == 0, 100)
    return rows.select("conv_id", "idx", p.alias("priority")).where("priority IS NOT NULL")


def shared_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the rules that both engines have, in all documents."""
    every = F.array(*(F.struct(F.lit(kind).alias("entity_type"), F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1)).alias("e")) for kind, p, _ in SHARED))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(every).alias("m"))
    return rows.select("doc_id", "m.entity_type", F.explode("m.e").alias("entity"), F.lit(1.0).alias("confidence"))


FOUND_SQL = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS entity_type, unnest(regexp_extract_all(text, '{p}')) AS entity FROM documents" for kind, p, _ in SHARED)


@query("findings_user_allowlist", f"""
SELECT entity_type, entity, count(*) AS n FROM ({FOUND_SQL}) WHERE NOT (entity IN ('11111', '22222') OR entity_type = 'token' OR regexp_matches(entity, '^[0-4]') OR regexp_matches(entity, '[.]org$')) GROUP BY ALL""")
def findings_user_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a user's list of texts, types and patterns doesn't allow."""
    kept = redaction.without_allowed(shared_findings(spark, sf_dir), exact=("11111", "22222"), categories=("token",), patterns=("^[0-4]", "[.]org$", "(broken"))
    return kept.groupBy("entity_type", "entity").agg(F.count(F.lit(1)).alias("n"))


@query("findings_merged", f"""
WITH f AS (SELECT DISTINCT doc_id, lower(entity) AS entity FROM ({FOUND_SQL}))
SELECT doc_id, entity FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.doc_id = f.doc_id AND g.entity <> f.entity AND contains(g.entity, f.entity))""")
def findings_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.merged(shared_findings(spark, sf_dir)).select("doc_id", F.lower("entity").alias("entity"))


@query("redaction_chain")
def redaction_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scanned, merged and redacted in one pass each (tested against one entity after the other)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = redaction.merged(redaction.without_allowed(findings.scan(docs), patterns=("example[.]",)))
    return redaction.redacted(docs, found).select("doc_id", "n_redacted", F.md5("text").alias("digest"))


@query("redaction_until_clean")
def redaction_until_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents masked until a scan finds nothing, three passes at most; ``left``: findings that stay."""
    folder = scratch(spark, "redaction")

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    docs, left = redaction.until_clean(table(spark, sf_dir, "documents").select("doc_id", "text"), findings.scan, write)
    counts = left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("left"))
    return docs.join(counts, "doc_id", "left").select("doc_id", F.md5("text").alias("digest"), F.coalesce("left", F.lit(0)).alias("left"))
