"""Loops: runs of calls that repeat exactly, with the same outcome, on the log lines of three clients.

events: ``session``, ``client``, ``event_id`` (null: known from a hook only),
``event_type``, ``event_key``, ``event_at``, ``value`` (the line), ``payload``
(a correction's line, may be null), ``seq`` (order of rows without an id).

A call's signature is what it runs and its arguments; of shell calls only the
fields that say what runs count. Its outcome is the normalised text of the
result with the same id. Each slot of a fingerprint is a hash of 16 hex
digits, so that fingerprints can be stored without the texts. Everything is
column expressions over parsed JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.text import normalized_outcome
from tracelake.functions.variant import at, filled_at, items_at, json_value, kind_at, text_at
from tracelake.sources.events import TOOLS

# Runs of so many calls are loops; what breaks a run; fields that identify a shell call.
THRESHOLDS = {"command_start": 3, "tool_call": 5}
BREAKERS = ("user_message", "compaction")
SHELL_FIELDS = ("cmd", "command", "cwd", "workdir")
CALL_IDS = ("$.id", "$.toolUseId", "$.toolCallId")
RESULT_IDS = ("$.tool_use_id", "$.toolUseId", "$.tool_call_id", "$.toolCallId", "$.id")
MESSAGE_IDS = ("$.toolCallId", "$.toolUseId", "$.tool_call_id", "$.tool_use_id")
CODEX_CALLS = ("function_call", "custom_tool_call")
CODEX_RESULTS = ("function_call_output", "custom_tool_call_output")
#: A text whose first five lines tell how a command ended, and what follows its output mark.
PREAMBLE = r"\A(?:[^\n]*\n){0,4}(?:Exit code: |Wall time: |Output:(?:\r?\n|\z))"
OUTPUT = r"(?s)(?:\A|\n)Output:\r?(?:\n(.*))?\z"


def stream_order() -> list[Column]:
    """A session's events in time, those without one last; rows known from hooks only come after what is as old."""
    return [F.col("event_at").asc_nulls_last(), F.col("event_id").isNull(), F.col("event_id"), F.col("seq")]


def is_shell(name: Column) -> Column:
    plain = F.lower(F.trim(name))
    return F.translate(plain, "-", "_").isin(*TOOLS["command_start"]) | plain.isin("sh", "zsh")


def key_id(*kinds: str) -> Column:
    """The id in an event key of one of the kinds."""
    return F.nullif(F.regexp_extract("event_key", rf"(?s)\A(?:{'|'.join(kinds)}):(.*)\z", 1), F.lit(""))


def json_text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "VOID", "").otherwise(F.coalesce(F.to_json(value), F.lit("")))


def signature(what: Column, args: Column) -> Column:
    """(what, args), null where there is nothing to run or call."""
    return F.when(F.coalesce(what, F.lit("")) != "", F.struct(what.alias("what"), args.alias("args")))


def shell_signature(args: str) -> Column:
    """Of a shell call's arguments (a column): the command, and the fields that identify it."""
    blank = lambda t: F.when(F.trim(t, F.lit(" \t\r\n")) != "", F.trim(t, F.lit(" \t\r\n")))

    def of(field: str) -> Column:
        value = F.try_variant_get(args, f"$.{field}", "string")
        words = F.try_variant_get(args, f"$.{field}", "array<variant>")
        joined = F.array_join(F.transform(words, lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("None"))), " ")
        kind = kind_at(F.col(args), f"$.{field}")
        return F.when(kind == "STRING", blank(value)).when(kind.startswith("ARRAY"), blank(joined))

    fields = F.concat_ws(",", *(F.concat(F.lit(f"{name}:"), F.to_json(at(F.col(args), f"$.{name}"))) for name in SHELL_FIELDS))
    return signature(F.coalesce(of("command"), of("cmd")), fields)


def block_of(v: Column, kinds: tuple[str, ...], ids: tuple[str, ...], wanted: Column) -> Column:
    """A message's first block of a kind that has the wanted id (any, if none is wanted)."""
    fits = lambda b: text_at(b, "$.type").isin(*kinds) & (wanted.isNull() | F.coalesce(filled_at(b, *ids) == wanted, F.lit(False)))
    return F.get(F.filter(items_at(v, "$.message.content"), fits), F.lit(0))


def flat_text(v: Column, path: str) -> Column:
    """A text, or the texts of a list joined by line feeds; null where there is none."""
    one = lambda b: F.coalesce(text_at(b, "$"), text_at(b, "$.text"))
    texts = F.filter(F.transform(items_at(v, path), one), lambda t: t.isNotNull())
    return F.coalesce(text_at(v, path), F.when(F.size(texts) > 0, F.array_join(texts, "\n")))


def with_calls(rows: DataFrame, line: str, out: str) -> DataFrame:
    """Adds ``out``: the signature (what, args) of the event's call in a line (a column), or null.

    Step by step, so that each step's value is found once a row.
    """
    v, shell, codex = F.col(line), F.col("event_type") == "command_start", F.col("client") == "codex"
    names = ["_block", "_text", "_name", "_args", "_typed"]
    rows = rows.withColumns({
        "_block": F.when(~codex, block_of(v, ("tool_use", "toolCall"), CALL_IDS, key_id("command_start", "tool_call"))),
        "_text": F.when(codex & text_at(v, "$.payload.type").isin(*CODEX_CALLS), F.trim(text_at(v, "$.payload.arguments"), F.lit(" \t\r\n"))),
        "_name": F.when(codex & text_at(v, "$.payload.type").isin(*CODEX_CALLS), text_at(v, "$.payload.name")),
        "_typed": F.when(~codex & shell & (text_at(v, "$.message.role") == "bashExecution"), filled_at(v, "$.message.command")),
    })
    block, given = F.col("_block"), at(v, "$.payload.arguments")
    own = F.when(kind_at(block, "$.input").isNotNull(), at(block, "$.input")).otherwise(at(block, "$.arguments"))
    rows = rows.withColumns({"_name": F.coalesce("_name", text_at(block, "$.name")), "_args": F.when(~codex, own).when(F.col("_text").isNotNull(), json_value(F.col("_text"))).when(F.col("_name").isNotNull(), given)})
    runs = (
        F.when(F.col("_typed").isNotNull(), signature(F.col("_typed"), F.concat(F.lit("command:"), F.col("_typed")))).when(is_shell(F.col("_name")), F.when(F.col("_args").isNull(), signature(F.col("_text"), F.col("_text"))).otherwise(shell_signature("_args")))
    )
    calls = signature(F.col("_name"), F.coalesce(F.when(F.col("_args").isNotNull(), json_text(F.col("_args"))), F.col("_text"), F.lit("")))
    return rows.withColumn(out, F.when(shell, runs).when(F.col("event_type") == "tool_call", calls)).drop(*names)


def with_results(rows: DataFrame, line: str, out: str) -> DataFrame:
    """Adds ``out``: the text of a result in a line (a column), for the id in the event's key; null where none can be seen."""
    v, codex, wanted = F.col(line), F.col("client") == "codex", key_id("tool_result")
    is_message = (F.col("client") == "openclaw") & (text_at(v, "$.message.role") == "toolResult")
    other = is_message & (filled_at(at(v, "$.message"), *MESSAGE_IDS) != wanted)
    rows = rows.withColumns({
        "_other": F.coalesce(other, F.lit(False)), "_told": F.when(is_message, flat_text(v, "$.message.content")), "_block": F.when(~codex, block_of(v, ("tool_result",), RESULT_IDS, wanted)),
        "_output": F.when(codex & text_at(v, "$.payload.type").isin(*CODEX_RESULTS), text_at(v, "$.payload.output")), "_listed": F.when(codex & text_at(v, "$.payload.type").isin(*CODEX_RESULTS), flat_text(v, "$.payload.output")),
    }).withColumn("_wrapped", json_value(F.col("_output")))
    wrapped = F.col("_wrapped")
    inner = F.when(F.schema_of_variant(wrapped).startswith("OBJECT"), F.coalesce(text_at(wrapped, "$.output"), F.to_json(wrapped))).otherwise(F.col("_output"))
    plain = F.col("_listed")  # the same text, if it is one
    told = F.when(plain.rlike(PREAMBLE), F.when(plain.rlike(OUTPUT), F.trim(F.regexp_extract(plain, OUTPUT, 1), F.lit(" \t\r\n")))).otherwise(plain)
    of_item = F.when(wrapped.isNotNull(), inner).otherwise(told)
    of_message = F.when(~F.col("_other"), F.coalesce("_told", flat_text(F.col("_block"), "$.content")))
    return rows.withColumn(out, F.when(codex, of_item).otherwise(of_message)).drop("_other", "_told", "_block", "_output", "_listed", "_wrapped")


def slot(text: Column) -> Column:
    return F.when(text == "", "").otherwise(F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 16)))


def fingerprints(events: DataFrame) -> DataFrame:
    """The events that matter to loops, with ``fingerprint`` (type, what, args, whether an outcome was seen, outcome) where they have one."""
    rows = events.withColumn("_p", json_value(F.col("payload"))).withColumn("_v", json_value(F.col("value")))
    columns = ["session", "client", "event_id", "event_type", "event_at", "seq"]
    calls = with_calls(with_calls(rows.where(F.col("event_type").isin(*THRESHOLDS, *BREAKERS)), "_p", "_c"), "_v", "_d")
    inline = F.coalesce(*(F.when(text_at(v, "$.message.role") == "bashExecution", flat_text(v, "$.message.output")) for v in (F.col("_p"), F.col("_v"))))
    inline = F.when((F.col("event_type") == "command_start") & (F.col("client") != "codex"), inline)
    calls = calls.select(*columns, key_id("command_start", "tool_call").alias("_id"), inline.alias("_inline"), F.coalesce("_c", "_d").alias("_call"))
    results = with_results(with_results(rows.where("event_type = 'tool_result'"), "_p", "_c"), "_v", "_d")
    place = F.struct(*(c.alias(f"o{i}") for i, c in enumerate((F.col("event_at").isNull(), F.col("event_at"), F.col("event_id").isNull(), F.col("event_id"), F.col("seq")))))
    results = results.select("session", key_id("tool_result").alias("_id"), F.coalesce("_c", "_d").alias("_text"), place.alias("_o"))
    first = results.where("_id IS NOT NULL AND _text IS NOT NULL").groupBy("session", "_id").agg(F.min_by("_text", "_o").alias("_text"))
    joined = calls.join(first, ["session", "_id"], "left")
    outcome = F.coalesce("_inline", "_text")
    name = F.col("_call.what")
    # A shell's tool call has its own event of a lower threshold.
    counts = F.col("_call").isNotNull() & F.col("event_id").isNotNull() & ~((F.col("event_type") == "tool_call") & is_shell(name))
    made = F.array(F.col("event_type"), slot(name), slot(F.col("_call.args")), F.when(outcome.isNull(), "missing").otherwise("present"), F.coalesce(slot(normalized_outcome(outcome)), F.lit("")))
    return joined.select(*columns, F.when(counts, made).alias("fingerprint"))


def loops(events: DataFrame, thresholds: dict[str, int] = THRESHOLDS) -> DataFrame:
    """session, event_type, fingerprint, count, first_event_id, last_event_id, event_ids, confidence of each loop.

    A call without a fingerprint, one known from a hook only, a user's message
    and a compaction end a run; other events don't. Confidence is medium where
    no outcome was seen.
    """
    rows = fingerprints(events)
    least = F.create_map(*(F.lit(x) for pair in thresholds.items() for x in pair))
    each = rows.withColumn("rule", F.explode(F.when(F.col("event_type").isin(*BREAKERS), F.array(*map(F.lit, thresholds))).otherwise(F.array("event_type"))))
    order = Window.partitionBy("session", "rule").orderBy(*stream_order())
    new = F.col("fingerprint").isNull() | ~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(order))
    islands = each.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = islands.where("fingerprint IS NOT NULL").groupBy("session", F.col("rule").alias("event_type"), "island", "fingerprint").agg(
        F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list(F.struct(F.col("event_at").isNull().alias("n"), "event_at", "event_id"))).alias("run")
    )
    ids = F.transform("run", lambda r: r["event_id"])
    seen = F.when(F.col("fingerprint")[3] == "present", "high").otherwise("medium")
    return runs.where(F.col("count") >= F.element_at(least, F.col("event_type"))).select(
        "session", "event_type", "fingerprint", "count", ids[0].alias("first_event_id"), F.element_at(ids, -1).alias("last_event_id"), ids.alias("event_ids"), seen.alias("confidence")
    )
