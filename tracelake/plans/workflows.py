"""Queries over the steps of sessions and their first sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import workflow
from tracelake.operators.workflow import oneliners
from tracelake.plans.registry import query, table

# Calls that the events stand in for: tool, input, output, then the step in a summary and in full.
CALLS = [
    ("Read", {"file_path": "src/a.py"}, "one\ntwo\n", "Read python file (2 lines)", "Read src/a.py (2 lines)"), ("Edit", {"file_path": "x/__tests__/b.ts", "old_string": "a\nb", "new_string": "c"}, "", "Edit test file (2 lines)", "Edit x/__tests__/b.ts (2 lines)"),
    ("Bash", {"command": "cd x && python -m pytest"}, "4 passed, 1 failed", "Test (4/5 passed)", "Test cd x && python -m pytest (4/5 passed)"), ("Bash", {"command": "git status"}, "clean", "Vcs", "Vcs git status"),
    ("Grep", {"pattern": "def "}, "", "Search", "Search def "), ("Task", {"description": "Look around"}, "", "Agent", "Agent Look around"), ("Fetch", {"query": 7}, "", "Fetch", "Fetch 7"), ("Write", {"file_path": "Dockerfile", "content": "FROM x"}, "", "Edit dockerfile (1 lines)", "Edit Dockerfile (1 lines)"),
]
_texts = lambda i: "[" + ", ".join(f"'{c[i]}'" for c in CALLS) + "]"
_line = lambda c: f"CASE WHEN count(*) <= 7 THEN string_agg({c}, ' → ' ORDER BY n) ELSE concat(string_agg(CASE WHEN n <= 5 THEN {c} END, ' → ' ORDER BY n), ' → ... ', count(*) - 7, ' more ... → ', string_agg(CASE WHEN n > total - 2 THEN {c} END, ' → ' ORDER BY n)) END"


@query("workflow_lines", f"""
WITH e AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total, ({_texts(3)})[event_id % {len(CALLS)} + 1] AS brief, ({_texts(4)})[event_id % {len(CALLS)} + 1] AS whole FROM events)
SELECT session, count(*) AS steps, {_line("brief")} AS summary, {_line("whole")} AS full FROM e GROUP BY session""")
def workflow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as arrow-separated steps, in a summary and in full; each event stands in for one of eight calls."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "event_id")
    nth = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(CALLS) + 1).cast("int"))
    keys = sorted({k for c in CALLS for k in c[1]})
    given = F.to_json(F.struct(*(nth([str(c[1][k]) if k in c[1] else None for c in CALLS]).alias(k) for k in keys)))
    steps = e.select("session", "event_id", workflow.step(nth([c[0] for c in CALLS]), given, nth([c[2] for c in CALLS])).alias("step"))
    return oneliners(steps, "session", ["event_id"], ("summary", "full"))


@query("first_sentences", r"""
WITH a AS (SELECT conv_id, turn, trim(regexp_replace(trim(split_part(text, chr(10), 1)), '<[^>]+>', '', 'g')) AS line FROM conversations WHERE text <> ''),
c AS (SELECT conv_id, turn, CASE WHEN contains(line, '. ') THEN split_part(line, '. ', 1) || '.' WHEN contains(line, '! ') THEN split_part(line, '! ', 1) || '!' WHEN contains(line, '? ') THEN split_part(line, '? ', 1) || '?' ELSE line END AS cut FROM a),
s AS (SELECT conv_id, turn, CASE WHEN len(string_split_regex(cut, '\s+')) > 15 THEN array_to_string(string_split_regex(cut, '\s+')[1:15], ' ') || '...' ELSE cut END AS short FROM c)
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(short, '`[^`]+`', '[code]', 'g'), 'https?://\S+', '[url]', 'g'), '[\p{L}\p{N}_./\-]+/[\p{L}\p{N}_./\-]+\.[\p{L}\p{N}_]+', '[file]', 'g') AS sentence FROM s""")
def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text <> ''")
    return c.select("conv_id", "turn", workflow.first_sentence(F.col("text")).alias("sentence"))
