"""Queries over sources, sinks and streams. Log lines are made of the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import variant
from tracelake.functions.time import vendor_timestamp
from tracelake.operators import canonical, loops, training
from tracelake.plans.ordered import overrides
from tracelake.plans.registry import ORACLES, query, table
from tracelake.sources import archives, bundles, events, jsonl, lines, store
from tracelake.sources.adapters import RECORDER_EVENTS_SQL, SESSIONS_SQL, recorder_events, sessions
from tracelake.streaming import checkpoints, frontier, ingest


def claude_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a client's log lines; every fifth answer calls a tool, most lines share their times, some have none."""
    c = table(spark, sf_dir, "conversations")
    quoted = lambda t: F.regexp_replace(F.to_json(F.array(t)), r"(?s)^\[(.*)\]$", "$1")
    text, call = F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.concat(F.lit("t"), F.col("turn").cast("string"))
    tool = F.concat(F.lit('{"type":"tool_use","id":"'), call, F.lit('","name":"Read","input":{"path":"a"}}'))
    blocks = F.concat(F.lit("["), F.to_json(text), F.lit(","), tool, F.lit("]"))
    content = F.when((F.col("role") == "assistant") & (F.col("turn") % 5 == 1), blocks).otherwise(quoted(F.col("text")))
    usage = F.to_json(F.struct(F.length("text").alias("input_tokens"), (F.col("turn") + 1).alias("output_tokens")))
    time = F.when(F.col("turn") % 4 < 3, F.format_string('"timestamp":"2026-01-01T00:00:%02dZ",', (F.col("turn") / 4).cast("int"))).otherwise("")
    return c.select(F.concat(
        F.lit('{"type":'), quoted(F.col("role")), F.lit(","), time, F.lit('"sessionId":"'), F.col("conv_id").cast("string"), F.lit('","message":{"role":'), quoted(F.col("role")),
        F.lit(',"model":"claude-opus-4-1","content":'), content, F.lit(',"usage":'), usage, F.lit("}}"),
    ).alias("value"))


@query("claude_messages", """
SELECT CAST(conv_id AS VARCHAR) AS session, role, text, CASE WHEN role = 'assistant' AND turn % 5 = 1 THEN concat('t', turn, ':Read') END AS tools FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''""")
def claude_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = jsonl.claude_messages(claude_lines(spark, sf_dir)).where("text <> ''")
    return m.select("session", "role", "text", F.array_join(F.transform("tools", lambda t: F.concat_ws(":", t["id"], t["name"])), ",").alias("tools"))


@query("claude_usage", """
SELECT CAST(conv_id AS VARCHAR) AS session, CAST(sum(length(text)) AS BIGINT) AS input, CAST(sum(turn + 1) AS BIGINT) AS output, CAST(0 AS BIGINT) AS cache_read, CAST(0 AS BIGINT) AS cache_write FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def claude_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.claude_usage(claude_lines(spark, sf_dir))


@query("codex_usage", """
WITH e AS (SELECT user_id AS session, event_id, CASE WHEN event_type = 'signup' THEN concat('gpt-5.', event_id % 4) END AS m, CAST(sum(1) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS total, event_type FROM events),
f AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY session ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS model FROM e)
SELECT session, arg_max(model, event_id) AS model, max(total * 10) AS input, max(total) AS output FROM f WHERE event_type = 'view' GROUP BY session""")
def codex_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.operators.sequence import by

    e = table(spark, sf_dir, "events").withColumn("total", F.sum(F.lit(1)).over(by("user_id", "event_id")))
    context = F.struct(F.lit("turn_context").alias("type"), F.struct(F.concat(F.lit("gpt-5."), (F.col("event_id") % 4).cast("string")).alias("model")).alias("payload"))
    tokens = F.struct((F.col("total") * 10).alias("input_tokens"), F.col("total").alias("output_tokens"))
    count = F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(tokens.alias("total_token_usage")).alias("info")).alias("payload"))
    value = F.when(F.col("event_type") == "signup", F.to_json(context)).when(F.col("event_type") == "view", F.to_json(count)).otherwise("no json")
    return jsonl.codex_usage(e.select(F.col("user_id").alias("session"), "event_id", value.alias("value")), "session", "event_id")


@query("classified_lines", """
SELECT CASE WHEN role = 'user' AND trim(text) <> '' THEN 'user_message' WHEN role = 'assistant' AND turn % 5 = 1 THEN 'assistant_message' ELSE 'schema_unknown' END AS event_type,
       CASE WHEN role = 'user' AND trim(text) <> '' OR role = 'assistant' AND turn % 5 = 1 THEN 'high' ELSE 'low' END AS confidence, count(*) AS n FROM conversations GROUP BY 1, 2""")
def classified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by their first event; answers that are plain text are unknown, as their content is a list of blocks."""
    rows = events.classified(claude_lines(spark, sf_dir), "claude").where("event_no = 0")
    return rows.groupBy("event_type", "confidence").agg(F.count(F.lit(1)).alias("n"))


def event_counts(rows: DataFrame) -> DataFrame:
    keyed = F.regexp_replace("event_key", r"\d+", "N").alias("event_key")
    return rows.groupBy("event_type", keyed, "confidence", "lossiness").agg(F.count(F.lit(1)).alias("n"))


def counts_sql(cases: list[tuple[str, str, str | None, str, str]], table_: str) -> str:
    """One row for each (condition, type, key, confidence, lossiness), summed up."""
    parts = [f"SELECT '{kind}' AS event_type, {'NULL' if key is None else repr(key)} AS event_key, '{sure}' AS confidence, '{lossy}' AS lossiness FROM {table_} WHERE {condition}" for condition, kind, key, sure, lossy in cases]
    return f"SELECT event_type, event_key, confidence, lossiness, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


@query("classified_events", counts_sql([
    ("role = 'user' AND trim(text) <> ''", "user_message", None, "high", "none"), ("role = 'assistant' AND turn % 5 = 1 AND trim(text) <> ''", "assistant_message", None, "high", "none"),
    ("role = 'assistant' AND turn % 5 = 1", "tool_call", "tool_call:tN", "high", "none"), ("role = 'assistant' AND turn % 5 = 1", "file_read", "file_read:tN", "high", "none"),
    ("role NOT IN ('user', 'assistant') OR role = 'assistant' AND turn % 5 <> 1 OR role = 'user' AND trim(text) = ''", "schema_unknown", None, "low", "none"),
], "conversations"))
def classified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of the lines, also those of content blocks."""
    return event_counts(events.classified(claude_lines(spark, sf_dir), "claude"))


def obj(**fields: object) -> Column:
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()))


def codex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rollout lines: starts, calls of tools, their results, messages, thoughts; some times have no zone."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    at = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(n % 7 == 0, "").otherwise("Z"))
    call = F.concat(F.lit("c"), n.cast("string"))
    name = F.element_at(F.array(*map(F.lit, ("Read", "edit", "apply-patch", " Bash ", "search"))), (n % 5 + 1).cast("int"))
    output = F.when(n % 3 == 0, F.concat(F.lit("done\nExit code: "), (n % 2).cast("string"))).when(n % 3 == 1, '{"output":"x","metadata":{"exit_code":0}}').otherwise("Exit code unknown")
    item = lambda **p: F.to_json(obj(timestamp=at, type="response_item", payload=obj(**p)))
    kind = F.col("event_type")
    value = (
        F.when(kind == "signup", F.to_json(obj(timestamp=at, type="session_meta", payload=obj(version="1.2")))).when(kind == "click", item(type="function_call", call_id=call, name=name))
        .when(kind == "purchase", item(type="function_call_output", call_id=call, output=output)).when(kind == "error", item(type="reasoning"))
        .otherwise(F.when(n % 2 == 0, F.to_json(obj(timestamp=at, type="event_msg", payload=obj(type="agent_message")))).otherwise("{broken"))
    )
    return e.select("user_id", "event_id", value.alias("value"))


def both_times(condition: str, kind: str, key: str | None) -> list[tuple[str, str, str | None, str, str]]:
    return [(f"({condition}) AND event_id % 7 <> 0", kind, key, "high", "none"), (f"({condition}) AND event_id % 7 = 0", kind, key, "low", "unknown")]


@query("classified_codex", counts_sql([
    *both_times("event_type = 'signup'", "session_open", None), *both_times("event_type = 'click'", "tool_call", "tool_call:cN"),
    *(x for i, kind in enumerate(("file_read", "file_write", "patch", "command_start")) for x in both_times(f"event_type = 'click' AND event_id % 5 = {i}", kind, f"{kind}:cN")),
    *both_times("event_type = 'purchase'", "tool_result", "tool_result:cN"), *both_times("event_type = 'purchase' AND event_id % 3 <> 2", "command_exit", "command_exit:cN"),
    ("event_type = 'error'", "assistant_message", None, "medium", "partial"), *both_times("event_type = 'view' AND event_id % 2 = 0", "assistant_message", None),
    ("event_type = 'view' AND event_id % 2 = 1", "schema_unknown", None, "missing", "none"),
], "events"))
def classified_codex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_counts(events.classified(codex_lines(spark, sf_dir), "codex"))


def openclaw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a client's messages; odd answers call a shell, system lines are results or commands of users."""
    c, n = table(spark, sf_dir, "conversations"), F.col("turn")
    call = F.concat(F.lit("k"), n.cast("string"))
    line = lambda **m: F.to_json(obj(type="message", timestamp=F.lit(1767225600000) + n, message=obj(**m)))
    block = lambda **b: obj(type=b.get("type"), text=b.get("text", F.lit(None).cast("string")), id=b.get("id", F.lit(None).cast("string")), name=b.get("name", F.lit(None).cast("string")))
    answer = line(role="assistant", content=F.array(block(type="text", text=F.col("text")), block(type="toolCall", id=call, name="exec_command")))
    value = (
        F.when(F.col("role") == "user", line(role="user", content=F.col("text"))).when((F.col("role") == "assistant") & (n % 2 == 1), answer)
        .when(F.col("role") == "assistant", F.to_json(obj(type="compaction", timestamp="2026-01-01T00:00:00Z")))
        .when(F.col("conv_id") % 2 == 0, line(role="toolResult", toolCallId=call)).otherwise(line(role="bashExecution", command=F.col("text"), output="out", exitCode=F.lit(1)))
    )
    return c.select("conv_id", "turn", value.alias("value"))


@query("classified_openclaw", counts_sql([
    ("role = 'user' AND trim(text) <> ''", "user_message", None, "high", "none"), ("role = 'user' AND trim(text) = ''", "schema_unknown", None, "low", "none"),
    ("role = 'assistant' AND turn % 2 = 1 AND trim(text) <> ''", "assistant_message", None, "high", "none"), ("role = 'assistant' AND turn % 2 = 1", "tool_call", "tool_call:kN", "high", "none"),
    ("role = 'assistant' AND turn % 2 = 1", "command_start", "command_start:kN", "high", "none"), ("role = 'assistant' AND turn % 2 = 0", "compaction", None, "high", "compacted"),
    ("role NOT IN ('user', 'assistant') AND conv_id % 2 = 0", "tool_result", "tool_result:kN", "high", "none"), ("role NOT IN ('user', 'assistant') AND conv_id % 2 = 1 AND trim(text) <> ''", "command_start", None, "high", "none"),
    ("role NOT IN ('user', 'assistant') AND conv_id % 2 = 1", "stdout_chunk", None, "low", "unknown"), ("role NOT IN ('user', 'assistant') AND conv_id % 2 = 1", "command_exit", None, "high", "none"),
], "conversations"))
def classified_openclaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_counts(events.classified(openclaw_lines(spark, sf_dir), "openclaw"))


@query("session_meta_lines", """
SELECT CASE event_type WHEN 'signup' THEN '1.2' END AS client_version, CAST(NULL AS VARCHAR) AS parent_session_id, false AS closure_seen, count(*) AS n FROM events GROUP BY ALL""")
def session_meta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = events.session_meta(codex_lines(spark, sf_dir), "codex")
    return meta.groupBy("client_version", "parent_session_id", "closure_seen").agg(F.count(F.lit(1)).alias("n"))


@query("canonical_json", """
SELECT md5(concat('{"a":', event_id % 5, ',"k":', CAST(props->>'$.k' AS VARCHAR), ',"z":[true,null]}')) AS digest, count(*) AS n FROM events GROUP BY 1""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of objects whose keys come in another order and whose numbers have another form."""
    k, a = F.get_json_object("props", "$.k"), (F.col("event_id") % 5).cast("string")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"z": [true, null], "k": '), k, F.lit(', "a": '), a, F.lit(".0}"))).otherwise(F.concat(F.lit('{"a":'), a, F.lit(', "z":[ true,null],"k":'), k, F.lit("}")))
    return table(spark, sf_dir, "events").groupBy(F.md5(variant.canonical(text)).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("typed_integers", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN -1 WHEN 3 THEN -1 WHEN 4 THEN -1 ELSE 1000000 END AS n FROM events""")
def typed_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers and integral floats count; booleans, strings and fractions give way to the next path."""
    i = F.col("event_id").cast("string")
    n = F.col("event_id") % 6
    value = F.when(n == 0, i).when(n == 1, F.concat(i, F.lit(".0"))).when(n == 2, "true").when(n == 3, F.concat(F.lit('"'), i, F.lit('"'))).when(n == 4, F.concat(i, F.lit(".5"))).otherwise("1e6")
    v = variant.json_value(F.concat(F.lit('{"usage": {"input": '), value, F.lit('}, "other": -1}')))
    return table(spark, sf_dir, "events").select("event_id", variant.integer_at(v, "$.usage.input", "$.other").alias("n"))


@query("line_cursor_ingest", """SELECT conv_id, turn, role, md5(text) AS digest, CAST(1 AS BIGINT) AS times FROM conversations""")
def line_cursor_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as growing sets of JSON lines, followed by line cursors in two runs of one query."""
    folder, c = store.scratch(spark, "lines"), table(spark, sf_dir, "conversations")
    rows = c.select((F.col("turn") % 2).alias("run"), F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/kept/batch={number}")

    for run in (0, 1):
        rows.where(F.col("run") == run).select("value").write.mode("append").text(f"{folder}/in")
        stream = lines.line_stream(spark, f"{folder}/in", glob="*.txt", split=1 << 20).writeStream.foreachBatch(keep)
        stream.option("checkpointLocation", f"{folder}/cursors").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema("path string, offset long, line string, batch int").parquet(f"{folder}/kept")
    parsed = kept.select(F.from_json("line", "conv_id long, turn long, role string, text string").alias("j"))
    return parsed.groupBy("j.conv_id", "j.turn", "j.role", F.md5("j.text").alias("digest")).agg(F.count(F.lit(1)).alias("times"))


TRACE_SQL = """
WITH RECURSIVE m AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS place, CASE WHEN event_type IN ('click', 'view') THEN 'user' ELSE 'assistant' END AS role, strlen(props) AS bytes, event_id * 1000 AS raw,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w(session, n, segment, first, messages, users, bytes, raw_start, closable) AS (
  SELECT session, n, 0, place, 1, CASE WHEN role = 'user' THEN 1 ELSE 0 END, bytes, CAST(0 AS BIGINT), role = 'assistant' AND raw + 1000 >= 8388608 FROM m WHERE n = 1
  UNION ALL
  SELECT session, n, segment, first, messages, users, bytes, raw_start, role = 'assistant' AND (messages >= 40 OR users >= 20 OR raw + 1000 - raw_start >= 8388608) FROM (
    SELECT m.session, m.n, m.role, m.raw, w.segment + k AS segment, CASE WHEN k = 1 THEN m.place ELSE w.first END AS first, CASE WHEN k = 1 THEN 0 ELSE w.messages END + 1 AS messages,
           CASE WHEN k = 1 THEN 0 ELSE w.users END + CASE WHEN m.role = 'user' THEN 1 ELSE 0 END AS users, CASE WHEN k = 1 THEN 0 ELSE w.bytes END + m.bytes AS bytes, CASE WHEN k = 1 THEN m.raw ELSE w.raw_start END AS raw_start
    FROM w JOIN m ON m.session = w.session AND m.n = w.n + 1, LATERAL (SELECT CASE WHEN w.closable AND m.role = 'user' THEN 1 ELSE 0 END AS k) x)),
s AS (SELECT w.session, segment, min(first) AS first, max(m.place) AS last, max(messages) AS messages, max(users) AS users, max(w.bytes) AS text_bytes, min(raw_start) AS raw_start FROM w JOIN m USING (session, n) GROUP BY 1, 2),
e AS (SELECT *, lead(raw_start) OVER (PARTITION BY session ORDER BY segment) AS raw_end FROM s)
SELECT session, segment, CASE WHEN segment = 0 THEN session ELSE session || '_seg-' || lpad(CAST(segment AS VARCHAR), 4, '0') END AS segment_id, first, last, messages, users, text_bytes,
       CASE WHEN raw_end IS NOT NULL THEN raw_start END AS raw_start, raw_end, raw_end IS NOT NULL AS sealed FROM e"""


def trace_messages(rows: DataFrame) -> DataFrame:
    """Events as messages of a trace: clicks and views of users, the rest of assistants; 1000 bytes each."""
    role = F.when(F.col("event_type").isin("click", "view"), "user").otherwise("assistant")
    raw = F.col("event_id") * 1000
    return rows.select(F.col("user_id").alias("session"), F.col("event_id").alias("place"), role.alias("role"), F.octet_length("props").alias("text_bytes"), raw.alias("raw_start"), (raw + 1000).alias("raw_end"))


@query("trace_checkpoints", TRACE_SQL)
def trace_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.segments(trace_messages(table(spark, sf_dir, "events")))


@query("trace_checkpoints_stream", TRACE_SQL)
def trace_checkpoints_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from two runs of a stateful stream, the second of which sees old messages again."""
    folder, e = store.scratch(spark, "traces"), table(spark, sf_dir, "events")
    middle = e.agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/kept/batch={number}")

    for rows in (e.where(F.col("event_id") <= middle), e.where((F.col("event_id") > middle) | (F.col("event_id") % 10 == 0))):
        rows.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(e.schema).parquet(f"{folder}/in")
        stream = checkpoints.stream_segments(trace_messages(source)).writeStream.outputMode("update").foreachBatch(keep)
        stream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return checkpoints.current(spark.read.parquet(f"{folder}/kept").drop("batch"))


@query("vendor_timestamps", """
SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE date_trunc('second', ts) END AS at, event_id % 4 = 3 AS naive FROM events""")
def vendor_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch milliseconds, ISO with Z, ISO with an offset, and text without a zone."""
    e = table(spark, sf_dir, "events").withColumn("t", F.date_trunc("second", "ts").cast("timestamp"))
    n = F.col("event_id") % 4
    text = (
        F.when(n == 0, F.unix_millis("t").cast("string")).when(n == 1, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(n == 2, F.date_format(F.col("t") + F.expr("INTERVAL 2 HOUR"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).otherwise(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss"))
    )
    at, naive = vendor_timestamp(F.col("text"))
    return e.select("event_id", text.alias("text")).select("event_id", at.cast("timestamp_ntz").alias("at"), naive.alias("naive"))


@query("session_headers", f"""
SELECT session, min(event_at) AS started_at, max(event_at) AS ended_at, arg_min(client, (event_at, event_id)) AS client, bool_or(type = 'signup') AS ended FROM {RECORDER_EVENTS_SQL} GROUP BY session""")
def session_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.session_headers(recorder_events(spark, sf_dir))


@query("snapshot_upsert", f"""
WITH o AS (SELECT session_id, status AS revision, score, outcome FROM {SESSIONS_SQL} WHERE session_id % 3 <> 0), n AS (SELECT session_id, CASE WHEN session_id % 2 = 0 THEN status ELSE 'X' END AS revision, CAST(NULL AS INTEGER) AS score, 'new' AS outcome FROM {SESSIONS_SQL} WHERE session_id % 5 <> 0)
SELECT coalesce(o.session_id, n.session_id) AS session_id, CASE WHEN n.revision IS NULL THEN o.revision ELSE n.revision END AS revision, CASE WHEN n.revision IS NULL OR n.revision IS NOT DISTINCT FROM o.revision THEN o.score ELSE n.score END AS score, CASE WHEN n.revision IS NULL THEN o.outcome ELSE n.outcome END AS outcome
FROM o FULL OUTER JOIN n ON o.session_id = n.session_id""")
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores survive an upsert only where the revision stayed the same."""
    s = sessions(spark, sf_dir)
    old = s.where("session_id % 3 <> 0").select("session_id", F.col("status").alias("revision"), "score", "outcome")
    fresh = s.where("session_id % 5 <> 0").select("session_id", F.when(F.col("session_id") % 2 == 0, F.col("status")).otherwise("X").alias("revision"), F.lit(None).cast("int").alias("score"), F.lit("new").alias("outcome"))
    return store.snapshot_upsert(old, fresh, "session_id", "revision", ["score"])


@query("training_turns", """
WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations), f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, g) AS first FROM t WHERE g > 0)
SELECT concat(conv_id, '-', CAST(g AS BIGINT)) AS turn_id, arg_min(text, turn) AS input, count(*) - 1 AS replies, coalesce(string_agg(CASE WHEN turn > first THEN text END, '|' ORDER BY turn), '') AS output FROM f GROUP BY conv_id, g""")
def training_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = store.training_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return turns.select("turn_id", "input", F.size("output").cast("long").alias("replies"), F.array_join("output", "|").alias("output"))


@query("async_collapse", """
WITH c AS (SELECT user_id AS session, event_id // 3000 AS turn, event_id AS place, event_type AS kind, concat('s', event_id % 3) AS sid FROM events),
w AS (SELECT *, lag(place) OVER k AS before, lag(kind) OVER k = 'click' AS waits, lead(place) OVER k IS NULL AS last FROM c WHERE kind IN ('click', 'view') WINDOW k AS (PARTITION BY session, turn, sid ORDER BY place)),
r AS (SELECT session, turn, place AS called, place AS answered, 'x' AS output, 'ok' AS status FROM c WHERE kind NOT IN ('click', 'view')
  UNION ALL SELECT session, turn, before, place, CASE WHEN place % 5 > 0 THEN concat('out ', place) END, CASE WHEN place % 5 > 0 THEN 'success' ELSE 'lost' END FROM w WHERE kind = 'view' AND waits
  UNION ALL SELECT session, turn, place, NULL, NULL, 'lost' FROM w WHERE kind = 'click' AND last)
SELECT r.session, r.turn, 'tc_' || substr(sha256(concat(r.session, '|', r.turn, '|', called)), 1, 8) AS id, answered, output, status FROM r""")
def async_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: clicks go on in the background under one of three ids, views poll these."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    sid, kind = F.concat(F.lit("s"), (n % 3).cast("string")), F.col("event_type")
    polled = F.when(n % 5 > 0, F.concat(F.lit("out "), n.cast("string"))).otherwise(F.concat(F.lit("No session found for "), sid))
    calls = e.select(
        F.col("user_id").alias("session"), F.expr("event_id div 3000").alias("turn"), n.alias("place"), F.when(kind == "click", "exec").when(kind == "view", "process").otherwise("read").alias("tool"),
        F.when(kind == "view", F.to_json(obj(sessionId=sid))).otherwise('{"timeout": 3}').alias("input"),
        F.when(kind == "click", F.concat(F.lit("Command still running (session "), sid, F.lit(", pid 1)"))).when(kind == "view", polled).otherwise("x").alias("output"), F.lit("ok").alias("status"),
    )
    results = training.collapsed(calls).where("type = 'tool_result'")
    return results.select("session", "turn", "id", F.when(F.col("place") < (1 << 62) - 1, F.col("place")).alias("answered"), "output", "status")


@query("export_roundtrip", f"""SELECT session_id, status, model, CAST(cost AS DOUBLE) AS cost FROM {SESSIONS_SQL} WHERE status <> 'P'""")
def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed columns written as JSON lines and read back; the manifest must agree."""
    folder = store.scratch(spark, "export")
    wanted = sessions(spark, sf_dir).where("status <> 'P'").withColumn("cost", F.col("cost").cast("double"))
    columns = ["session_id", "status", "model", "cost"]
    sent = store.export_jsonl(wanted, columns, folder).first()
    lines = jsonl.read_lines(spark, folder)
    if store.manifest(lines.select("value")).first() != sent:
        raise ValueError("the manifest does not agree with the lines")
    return jsonl.parsed(lines, "session_id bigint, status string, model string, cost double", strict=True).select("j.*")


@query("stream_ingest_equals_batch", """
SELECT user_id, count(*) AS events, min(ts) AS started_at, max(ts) AS ended_at, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY user_id""")
def stream_ingest_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed in by file; the result equals one batch over all of them."""
    return ingest.ingest(spark, f"{sf_dir}/events.parque[t]", ["event_id"])


def loop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls on three clients' lines: clicks run a command, whose description drifts, views read a file; signups are users' messages."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    client = F.element_at(F.array(F.lit("claude"), F.lit("codex"), F.lit("openclaw")), (F.col("user_id") % 3 + 1).cast("int"))
    tool, click = F.concat(F.lit("t"), n.cast("string")), F.col("event_type") == "click"
    command = F.when(n % 7 == 0, "make lint").otherwise("make test")
    args = F.when(click, F.to_json(obj(description=F.concat(F.lit("try "), n.cast("string")), command=command))).when(n % 2 == 0, '{"path":"a","n":1}').otherwise('{"n": 1, "path": "a"}')
    name = F.when(click, "Bash").otherwise("Read")
    block = lambda kind, field: F.concat(F.lit(f'{{"message":{{"content":[{{"type":"{kind}","id":"'), tool, F.lit('","name":"'), name, F.lit(f'","{field}":'), args, F.lit("}]}}"))
    item = F.to_json(obj(payload=obj(type="function_call", call_id=tool, name=name, arguments=args)))
    value = F.when(client == "claude", block("tool_use", "input")).when(client == "openclaw", block("toolCall", "arguments")).otherwise(item)
    kind = F.when(click, "command_start").when(F.col("event_type") == "view", "tool_call").when(F.col("event_type") == "signup", "user_message")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    columns = [F.col("user_id").alias("session"), client.alias("client")]
    calls = e.where(kind.isNotNull()).select(*columns, n.alias("event_id"), kind.alias("event_type"), F.concat(kind, F.lit(":"), tool).alias("event_key"), at.alias("event_at"), value.alias("value"), F.lit(None).cast("string").alias("payload"), F.lit(0).cast("long").alias("seq"))
    said = F.concat(F.lit("done by pid "), n.cast("string"))
    result = (
        F.when(client == "claude", F.to_json(obj(message=obj(content=F.array(obj(type="tool_result", tool_use_id=tool, content=said))))))
        .when(client == "openclaw", F.to_json(obj(message=obj(role="toolResult", toolCallId=tool, content=said)))).otherwise(F.to_json(obj(payload=obj(type="function_call_output", call_id=tool, output=F.concat(F.lit("Exit code: 0\nOutput:\n"), said)))))
    )
    results = e.where(click & (n % 4 > 0)).select(*columns, (-n).alias("event_id"), F.lit("tool_result").alias("event_type"), F.concat(F.lit("tool_result:"), tool).alias("event_key"), at.alias("event_at"), result.alias("value"), F.lit(None).cast("string").alias("payload"), F.lit(0).cast("long").alias("seq"))
    hooks = e.where(n % 53 == 0).select(*columns, F.lit(None).cast("long").alias("event_id"), F.lit("command_start").alias("event_type"), F.lit(None).cast("string").alias("event_key"), at.alias("event_at"), F.lit(None).cast("string").alias("value"), F.lit("{}").alias("payload"), n.alias("seq"))
    return calls.unionByName(results).unionByName(hooks)


@query("loop_incidents", """
WITH b AS (SELECT user_id AS session, ts, event_id, 0 AS hook, event_id AS seq, CASE event_type WHEN 'click' THEN 'command_start' WHEN 'view' THEN 'tool_call' WHEN 'signup' THEN 'user_message' END AS kind,
  CASE event_type WHEN 'click' THEN concat(CASE WHEN event_id % 7 = 0 THEN 'make lint' ELSE 'make test' END, '|', event_id % 4 > 0) WHEN 'view' THEN 'Read|false' END AS fp FROM events),
h AS (SELECT * FROM b WHERE kind IS NOT NULL UNION ALL SELECT user_id, ts, NULL, 1, event_id, 'command_start', NULL FROM events WHERE event_id % 53 = 0),
c AS (SELECT h.*, r.rule FROM h JOIN (VALUES ('command_start', 3), ('tool_call', 5)) r(rule, least) ON h.kind = r.rule OR h.kind = 'user_message'),
m AS (SELECT *, CASE WHEN fp IS NULL OR fp IS DISTINCT FROM lag(fp) OVER w THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY session, rule ORDER BY ts, hook, seq)),
i AS (SELECT *, sum(new) OVER (PARTITION BY session, rule ORDER BY ts, hook, seq ROWS UNBOUNDED PRECEDING) AS island FROM m),
g AS (SELECT session, rule, fp, count(*) AS n, arg_min(event_id, (ts, event_id)) AS first, arg_max(event_id, (ts, event_id)) AS last FROM i WHERE fp IS NOT NULL GROUP BY session, rule, island, fp)
SELECT session, rule AS event_type, 'sha256:' || substr(sha256(split_part(fp, '|', 1)), 1, 16) AS what, n AS count, first AS first_event_id, last AS last_event_id, CASE WHEN fp LIKE '%true' THEN 'high' ELSE 'medium' END AS confidence
FROM g WHERE n >= CASE rule WHEN 'command_start' THEN 3 ELSE 5 END""")
def loop_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops on the lines of three clients, with rows known from hooks only placed by their times."""
    found = loops.loops(loop_events(spark, sf_dir))
    return found.select("session", "event_type", F.col("fingerprint")[1].alias("what"), "count", "first_event_id", "last_event_id", "confidence")


@query("frontier_consumer", f"SELECT session, type, origin, count(*) AS n FROM ({ORACLES['canonical_override_merge']}) GROUP BY ALL")
def frontier_consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical types of each session by a consumer that saw half of the events, then the rest, then all corrections but the first ones."""
    folder, e, o = store.scratch(spark, "consumer"), recorder_events(spark, sf_dir), overrides(spark, sf_dir)
    middle = e.agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0

    def compute(rows: DataFrame, corrections: DataFrame | None) -> DataFrame:
        return canonical.merged(rows, corrections).groupBy("session", "type", "origin").agg(F.count(F.lit(1)).alias("n"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in compute(e, o).schema)
    consumer = frontier.Consumer(spark, folder, compute, schema)
    steps = [(e.where(F.col("event_id") <= middle), o.where(F.col("write_seq") <= middle / 2)), (e.where(F.col("event_id") > middle), None), (None, o.where(F.col("write_seq") > middle / 2))]
    for events_, corrections in steps:
        if events_ is not None:
            frontier.append(events_, f"{folder}/events")
        if corrections is not None:
            frontier.append(corrections, f"{folder}/overrides")
        consumer.advance(*(spark.read.parquet(f"{folder}/{n}") for n in ("events", "overrides")))
    return consumer.results()


@query("bundle_roundtrip", """
SELECT concat('claude:', user_id) AS session_key, 1 + count(*) + count(CASE WHEN event_type = 'purchase' THEN 1 END) + count(CASE WHEN event_id % 11 = 0 THEN 1 END) + 1 AS n, true AS same FROM events GROUP BY user_id""")
def bundle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a store, exported, imported into a store that has every seventh session under other ids, and exported again."""
    e, folder = table(spark, sf_dir, "events"), store.scratch(spark, "bundles")
    user, n = F.col("user_id"), F.col("event_id")
    key = F.concat(F.lit("claude:"), user.cast("string"))
    whole = {
        "sessions": e.groupBy("user_id").agg(F.min("ts").cast("string").alias("started_at")).select(user.alias("id"), key.alias("session_key"), "started_at"),
        "events": e.select(n.alias("id"), user.alias("session_id"), F.lit("log").alias("source"), F.concat(F.lit("p"), (n % 5).cast("string")).alias("source_path"), n.alias("source_offset"), F.lit(0).alias("seq"), F.col("event_type").alias("type"), F.col("props").alias("raw_json")),
        "overrides": e.where(n % 11 == 0).select(user.alias("session_id"), F.concat(F.lit("k"), n.cast("string")).alias("event_key"), F.lit("fixed").alias("type")),
        "usage": e.where("event_type = 'purchase'").select(n.alias("event_id"), user.alias("session_id"), F.col("value").alias("cost")),
        "incidents": e.groupBy("user_id").agg(F.min("event_id").alias("first_event_id"), F.max("event_id").alias("last_event_id"), F.count(F.lit(1)).alias("count")).select(user.alias("id"), user.alias("session_id"), "first_event_id", "last_event_id", "count"),
    }
    own = {k: df.limit(0) for k, df in whole.items()} | {"sessions": whole["sessions"].where("id % 7 = 0").withColumn("id", F.col("id") + 1_000_000)}

    def write(df: DataFrame, name: str) -> DataFrame:
        path = store.scratch(spark, f"bundle-{name}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    bundles.export(whole, folder)
    records, _ = bundles.verified(spark, folder)
    got = bundles.manifest(bundles.records(bundles.imported(records, own, write)))
    first = bundles.promised(spark, folder).select("session_key", F.col("digest").alias("_d"))  # the records met it, see verified()
    return got.join(first, "session_key").select("session_key", "n", (F.col("digest") == F.col("_d")).alias("same"))


@query("archive_import", r"""
WITH m AS (SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations WHERE role IN ('user', 'assistant'))
SELECT CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN conv_id % 3 = 0 THEN 'gpt-5' ELSE 'unknown' END AS model, count(CASE WHEN role = 'user' THEN 1 END) AS user_messages, count(CASE WHEN role = 'assistant' THEN 1 END) AS assistant_messages,
       md5(string_agg(role || md5(text), ',' ORDER BY turn)) AS digest FROM m WHERE text <> '' GROUP BY conv_id""")
def archive_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as members of zip archives in three layouts, read back by probing.

    An archive has up to 200 conversations: whole objects, a message a line, and
    lists in lists behind a log head.
    """
    folder = store.scratch(spark, "archives")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    one = c.groupBy("conv_id").agg(turns.alias("t"))
    key = F.col("conv_id").cast("string")
    plain = F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    line = lambda m: F.to_json(F.struct(F.col("conv_id").alias("session_id"), m["role"].alias("sender"), F.array(F.struct(F.lit("text").alias("type"), m["text"].alias("text"))).alias("content")))
    whole = F.to_json(F.struct(key.alias("sessionId"), F.lit("gpt-5").alias("modelName"), plain.alias("messages")))
    nested = F.concat(F.lit("INFO exported "), F.to_json(F.struct(F.array(F.struct(key.alias("taskId"), plain.alias("history"))).alias("data"))))
    layout = F.col("conv_id") % 3
    text = F.when(layout == 0, whole).when(layout == 1, F.array_join(F.transform("t", line), "\n")).otherwise(nested)
    member = F.concat(key, F.when(layout == 0, ".json").when(layout == 1, ".jsonl").otherwise(".ndjson"))
    archives.write_archives(one.select(F.floor(F.col("conv_id") / 200).cast("string").alias("archive"), member.alias("member"), text.alias("text")), f"{folder}/in")
    heads, said, _ = archives.imported(spark, f"{folder}/in", kept)
    digests = said.groupBy("session_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("role", F.md5("text")).alias("d")))), lambda x: x["d"]), ",")).alias("digest"))
    return heads.join(digests, "session_id").select("session_id", "model", "user_messages", "assistant_messages", "digest")
