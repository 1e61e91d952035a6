"""Training sequences of a session's turns: asynchronous calls collapsed with their polls, inputs and outputs cleaned.

calls: ``session``, ``turn``, ``place`` (order within a turn), ``tool``,
``input`` (JSON), ``output`` (text or null), ``status``. A call that goes on
in the background names an id in its output; a later ``process`` call with
this id has its result. Which call a poll resolves is what stands before it
among the calls and polls of one id, so windows decide it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.variant import filled_at, json_value

# How a running call names its id; parameters that say nothing of the task; box drawing.
RUNNING = r"Command still running \(session (\S+),"
PLUMBING = {"exec": ("workdir", "yieldMs", "timeout", "elevated", "host", "security", "ask"), "process": ("timeout", "offset", "limit")}
BOX = "─│┌┐└┘├┤┬┴┼╭╮╰╯╱╲╳═║╔╗╚╝╠╣╦╩╬◇◆●○■□▪▫▸▹►◂◃◄"
BARS = "│┃┆┇┊┋"


def _kept(keys: tuple[str, ...]):
    return lambda k, _: ~k.isin(*keys)


def clean_input(tool: Column, value: Column) -> Column:
    """A call's arguments, canonical, without parameters of the machinery."""
    fields = F.try_variant_get(json_value(value), "$", "map<string, variant>")
    out = F.to_json(json_value(value))
    for name, keys in PLUMBING.items():
        out = F.when((tool == name) & fields.isNotNull(), F.to_json(F.map_filter(fields, _kept(keys)))).otherwise(out)
    return out


def clean_output(text: Column) -> Column:
    """Lines without frames: those that are nearly all box drawing go, bars at their ends as well."""

    def drawn(line: Column) -> Column:
        bare = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
        boxes = F.length(bare) - F.length(F.translate(bare, BOX, ""))
        return (F.length(bare) > 3) & (boxes > 0.8 * F.length(bare))

    kept = F.filter(F.split(text, "\n", -1), lambda line: ~drawn(line))
    return F.array_join(F.transform(kept, lambda line: F.regexp_replace(F.regexp_replace(line, rf"(?U)^[{BARS}]+\s?", ""), rf"(?U)\s?[{BARS}]+$", "")), "\n")


def call_id(place: str) -> Column:
    return F.concat(F.lit("tc_"), F.substring(F.sha2(F.concat_ws("|", F.col("session").cast("string"), F.col("turn").cast("string"), F.col(place).cast("string")), 256), 1, 8))


def collapsed(calls: DataFrame) -> DataFrame:
    """A ``tool_call`` for each call that runs something and a ``tool_result`` for its outcome, in order.

    A poll gives the result of the call that waits for its id, ``lost`` where
    it says nothing or that the id is unknown; polls that nobody waits for go;
    calls that are never polled are lost at the end of the turn; a call whose
    id another call takes over has no result.
    """
    polled = F.when(F.col("tool") == "process", filled_at(json_value(F.col("input")), "$.sessionId"))
    running = F.when(polled.isNull() & F.col("output").rlike(RUNNING), F.regexp_extract("output", RUNNING, 1))
    rows = calls.withColumns({"_poll": polled, "_run": running})
    waits = rows.where("_poll IS NOT NULL OR _run IS NOT NULL").withColumn("_sid", F.coalesce("_poll", "_run"))
    by_id = Window.partitionBy("session", "turn", "_sid").orderBy("place")
    waits = waits.withColumns({
        "_before": F.lag("place").over(by_id), "_before_runs": F.lag(F.col("_run").isNotNull()).over(by_id), "_last": F.lead("place").over(by_id).isNull(),
    })
    null = F.lit(None).cast("string")

    def item(df: DataFrame, place: Column, part: Column, kind: str, id_: Column, name: Column, arguments: Column, output: Column, status: Column) -> DataFrame:
        return df.select("session", "turn", place.cast("long").alias("place"), part.cast("int").alias("part"), F.lit(kind).alias("type"), id_.alias("id"), name.alias("name"), arguments.alias("arguments"), output.alias("output"), status.alias("status"))

    at = F.col("place")
    own = rows.where("_poll IS NULL")
    said = item(own, at, F.lit(0), "tool_call", call_id("place"), F.col("tool"), clean_input(F.col("tool"), F.col("input")), null, null)
    done = item(own.where("_run IS NULL"), at, F.lit(1), "tool_result", call_id("place"), null, null, clean_output(F.coalesce("output", F.lit(""))), F.col("status"))
    text = F.coalesce("output", F.lit(""))
    empty = (text == "") | (text == F.concat(F.lit("No session found for "), F.col("_sid")))
    polls = waits.where("_poll IS NOT NULL AND _before_runs")
    answered = item(polls, at, F.lit(1), "tool_result", call_id("_before"), null, null, F.when(~empty, clean_output(text)), F.when(empty, "lost").otherwise("success"))
    end = F.lit((1 << 62) - 1)
    # Lost ones come last, in the order in which their ids were first waited for since their last answer.
    first = Window.partitionBy("session", "turn").orderBy("_first")
    chain = waits.withColumn("_answered", F.max(F.when(F.col("_poll").isNotNull() & F.col("_before_runs"), at)).over(by_id.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    opened = Window.partitionBy("session", "turn", "_sid", "_answered")
    chain = chain.withColumn("_first", F.min(F.when(F.col("_run").isNotNull(), at)).over(opened))
    unpolled = chain.where("_run IS NOT NULL AND _last").withColumn("_rank", F.row_number().over(first))
    lost = item(unpolled, end, F.col("_rank"), "tool_result", call_id("place"), null, null, null, F.lit("lost"))
    return said.unionByName(done).unionByName(answered).unionByName(lost)
