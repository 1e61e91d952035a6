"""JSON-lines sources: tolerant or strict lines, and the vendors' session logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.sequence import asof_fill


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, value: lines that end in a line feed only; other Unicode breaks stay inside."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    return lines.select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r$", "").alias("value")).where("trim(value) <> ''")


def parsed(lines: DataFrame, schema: str, strict: bool = False) -> DataFrame:
    """``lines`` with ``j``; lines that are no JSON objects have a null one, or fail if strict."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    return lines.withColumn("j", F.when(F.col("value").rlike(r"^\s*\{"), F.from_json("value", schema, {"mode": mode})))


BLOCK = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string>>"
CLAUDE = "type string, timestamp string, sessionId string, cwd string, gitBranch string, message struct<role:string, model:string, content:string, usage:struct<input_tokens:bigint, output_tokens:bigint, cache_read_input_tokens:bigint, cache_creation_input_tokens:bigint>>"


def blocks(content: Column) -> Column:
    """A message's content as blocks; plain text is one text block."""
    text = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *(F.lit(None).cast("string").alias(n) for n in ("thinking", "id", "name", "input", "tool_use_id", "content"))))
    found = F.when(content.rlike(r"^\[\s*[{\]]"), F.from_json(content, BLOCK))
    return F.coalesce(found, text)


def claude_messages(lines: DataFrame) -> DataFrame:
    """line, session, at, role, text, thinking, model, tools (name, id, result) of a client's log lines.

    Tool results stand in later lines; they are joined to their calls by id.
    Only lines with calls are shuffled, and come together again by the number
    of their line, whatever their times.
    """
    rows = parsed(lines.withColumn("_line", F.monotonically_increasing_id()), CLAUDE).where("j.type IN ('user', 'assistant')")
    rows = rows.select(F.col("_line").alias("line"), F.col("j.sessionId").alias("session"), F.col("j.timestamp").alias("at"), F.col("j.type").alias("role"), F.col("j.message.model").alias("model"), blocks(F.col("j.message.content")).alias("b"))
    results = rows.select("session", F.explode("b").alias("r")).where("r.type = 'tool_result'")
    results = results.groupBy(F.col("session").alias("_s"), F.col("r.tool_use_id").alias("_id")).agg(F.first("r.content", ignorenulls=True).alias("result"))
    joined = lambda kind, field: F.array_join(F.transform(F.filter("b", lambda x: x["type"] == kind), lambda x: x[field]), "\n")
    calls = F.transform(F.filter("b", lambda x: x["type"] == "tool_use"), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name")))
    rows = rows.select("line", "session", "at", "role", joined("text", "text").alias("text"), joined("thinking", "thinking").alias("thinking"), "model", calls.alias("calls"))
    tool = "array<struct<id: string, name: string, result: string>>"
    plain = rows.where("size(calls) = 0 AND (text <> '' OR thinking <> '')").drop("calls").withColumn("tools", F.lit(None).cast(tool))
    each = rows.where("size(calls) > 0").select("*", F.posexplode("calls").alias("_n", "_c"))
    each = each.join(results, each["session"].eqNullSafe(results["_s"]) & (F.col("_c.id") == results["_id"]), "left")
    first = [F.first(c).alias(c) for c in ("session", "at", "role", "text", "thinking", "model")]
    tools = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_c", "result"))), lambda x: F.struct(x["_c"]["id"].alias("id"), x["_c"]["name"].alias("name"), x["result"].alias("result")))
    return plain.unionByName(each.groupBy("line").agg(*first, tools.cast(tool).alias("tools")))


def claude_usage(lines: DataFrame) -> DataFrame:
    """Tokens of each session: input, output, cache reads and writes."""
    rows = parsed(lines, CLAUDE).where("j.type = 'assistant'")
    u = "j.message.usage."
    total = lambda n: F.coalesce(F.sum(u + n), F.lit(0))
    return rows.groupBy(F.col("j.sessionId").alias("session")).agg(
        total("input_tokens").alias("input"), total("output_tokens").alias("output"), total("cache_read_input_tokens").alias("cache_read"), total("cache_creation_input_tokens").alias("cache_write")
    )


CODEX = "timestamp string, type string, payload struct<type:string, id:string, model:string, role:string, info:struct<total_token_usage:struct<input_tokens:bigint, output_tokens:bigint>>>"


def codex_usage(lines: DataFrame, session: str, order: str) -> DataFrame:
    """session, model, input, output: running totals' maxima under the model last named before.

    ``lines`` has the session and the line order beside the value.
    """
    rows = parsed(lines, CODEX)
    filled = asof_fill(rows, session, [order], F.when(F.col("j.type") == "turn_context", F.col("j.payload.model")), "model")
    counts = filled.where("j.type = 'event_msg' AND j.payload.type = 'token_count'")
    total = "j.payload.info.total_token_usage."
    last = F.max_by("model", order)
    return counts.groupBy(session).agg(last.alias("model"), F.max(total + "input_tokens").alias("input"), F.max(total + "output_tokens").alias("output"))
