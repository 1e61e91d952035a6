"""Events of the vendors' log lines, as column expressions over parsed JSON.

What the rules ask of a line more than once (``PARTS``) is read into columns
first, each once a line; within branches Spark would read it again each time.
A line gives an array of events (type, key, confidence, lossiness). Confidence
and lossiness are those of the line's time unless an event has its own: a time
without a zone makes both unsure. A line that nothing matches is one
``schema_unknown`` of low confidence; one that is no JSON object is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.time import vendor_timestamp
from tracelake.functions.variant import filled_at, is_object, items_at, json_value, kind_at, text_at

# Events of whole lines, by client and line type.
CLOSING = {"session_close": "session_close", "session_end": "session_close"}
APPROVAL = {"approval_request": "approval_request", "approval_decision": "approval_decision"}
LINES = {
    "claude": {"compaction": "compaction"} | CLOSING | APPROVAL,
    "codex": {"session_meta": "session_open"} | CLOSING | APPROVAL,
    "openclaw": {"session": "session_open", "compaction": "compaction"} | CLOSING | APPROVAL,
}
# What a tool of a name does beside being called.
TOOLS = {
    "file_read": ("read", "read_file", "readmanyfiles", "view", "view_image"),
    "file_write": ("write", "write_file", "edit", "edit_file", "multiedit", "notebookedit"),
    "patch": ("apply_patch", "patch"),
    "command_start": ("bash", "exec", "exec_command", "shell", "shell_command"),
}
#: A line of a text that tells how a command ended.
EXIT = r"(?:^|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029])Exit code: "
EVENT = "event_type string, event_key string, confidence string, lossiness string"


def event(kind: str | Column, key: Column | None = None, confidence: str | None = None, lossiness: str | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    key = F.lit(None) if key is None else F.concat(kind, F.lit(":"), key)
    return F.struct(kind.alias("event_type"), key.cast("string").alias("event_key"), F.lit(confidence).cast("string").alias("confidence"), F.lit(lossiness).cast("string").alias("lossiness"))


def some(*pairs: tuple[Column, Column]) -> Column:
    """The events whose condition holds, in order."""
    return F.filter(F.array(*(F.when(condition, e) for condition, e in pairs)), lambda e: e.isNotNull())


def tool_events(name: Column, key: Column) -> Column:
    plain = F.translate(F.lower(F.trim(name)), "-", "_")
    return some((F.lit(True), event("tool_call", key)), *((plain.isin(*names), event(kind, key)) for kind, names in TOOLS.items()))


def named(kind: Column, events: dict[str, str]) -> Column:
    """The one event that a type names, else null."""
    table = F.create_map(*(F.lit(x) for pair in events.items() for x in pair))
    return F.when(kind.isin(*events), F.array(event(F.element_at(table, kind))))


def message_events(kind: str, blocks: Column, said: Column, of_block) -> Column:
    """A message event if something was said, then the events of each block."""
    each = F.flatten(F.transform(blocks, of_block))
    return F.concat(some((F.coalesce(said, F.lit(False)), event(kind))), F.coalesce(each, F.array().cast(f"array<struct<{EVENT}>>")))


def nothing() -> Column:
    return F.array().cast(f"array<struct<{EVENT}>>")


def shell_events(v: Column) -> Column:
    """A command that a user ran: its start, its output, its end."""
    ended = kind_at(v, "$.message.exitCode")
    return some(
        (filled_at(v, "$.message.command").isNotNull(), event("command_start", None, "high", "none")),
        (filled_at(v, "$.message.output").isNotNull(), event("stdout_chunk", None, "low", "unknown")),
        (ended.isNotNull() & (ended != "VOID"), event("command_exit", None, "high", "none")),
    )


def spoken(blocks: Column, kinds: tuple[str, ...], *paths: str) -> Column:
    return F.exists(blocks, lambda b: (text_at(b, "$.type").isin(*kinds) if kinds else F.lit(True)) & filled_at(b, *paths).isNotNull())


def assistant_events(v: Column, calls: tuple[str, ...], *ids: str) -> Column:
    blocks = items_at(v, "$.message.content")
    said = spoken(blocks, ("text", "thinking"), "$.text", "$.thinking")
    return message_events("assistant_message", blocks, said, lambda b: F.when(text_at(b, "$.type").isin(*calls), tool_events(text_at(b, "$.name"), filled_at(b, *ids))).otherwise(nothing()))


def claude(v: Column, kind: Column, role: Column) -> Column:
    blocks, content = items_at(v, "$.message.content"), filled_at(v, "$.message.content")
    result = lambda b: F.when(text_at(b, "$.type") == "tool_result", F.array(event("tool_result", filled_at(b, "$.tool_use_id", "$.toolUseId")))).otherwise(nothing())
    user = message_events("user_message", blocks, content.isNotNull() | spoken(blocks, ("text",), "$.text"), result)
    by_type = named(kind, LINES["claude"])
    return (
        F.when(kind.isin("compaction", *CLOSING), by_type).when(role == "bashExecution", shell_events(v))
        .when(kind == "user", user).when(kind == "assistant", assistant_events(v, ("tool_use", "toolCall"), "$.id", "$.toolUseId")).otherwise(by_type)
    )


def openclaw(v: Column, kind: Column, role: Column) -> Column:
    said = filled_at(v, "$.message.content").isNotNull() | spoken(items_at(v, "$.message.content"), (), "$.text")
    message = (
        F.when(role == "user", some((F.coalesce(said, F.lit(False)), event("user_message")))).when(role == "assistant", assistant_events(v, ("toolCall",), "$.id"))
        .when(role == "toolResult", F.array(event("tool_result", filled_at(v, "$.message.toolCallId")))).when(role == "bashExecution", shell_events(v)).otherwise(named(role, APPROVAL))
    )
    return F.when(kind == "message", message).otherwise(named(kind, LINES["openclaw"]))


def codex(v: Column, kind: Column, item: Column, call_id: Column, name: Column, output: Column) -> Column:
    key = F.when(call_id.rlike(r"\S"), call_id)
    tells = lambda text: F.coalesce(text.rlike(EXIT), F.lit(False))
    in_blocks = F.exists(items_at(v, "$.payload.output"), lambda b: (text_at(b, "$.type") == "input_text") & tells(text_at(b, "$.text")))
    ended = tells(output) | kind_at(json_value(output), "$.metadata.exit_code").isNotNull() | F.coalesce(in_blocks, F.lit(False))
    thought = F.array(event("assistant_message", None, "medium", "partial"))
    both = named(item, APPROVAL | CLOSING)
    response = (
        F.when(item.isin("function_call", "custom_tool_call"), tool_events(name, key))
        .when(item.isin("function_call_output", "custom_tool_call_output"), some((F.lit(True), event("tool_result", key)), (ended, event("command_exit", key))))
        .when(item == "reasoning", thought).otherwise(both)
    )
    told = F.when(item == "agent_reasoning", thought).otherwise(F.coalesce(named(item, {"user_message": "user_message", "agent_message": "assistant_message"}), both))
    return F.when(kind == "response_item", response).when(kind == "event_msg", told).otherwise(named(kind, LINES["codex"]))


CLIENTS = {"claude": claude, "codex": codex, "openclaw": openclaw}
#: Strings of a line that its client's rules take, in the order of their parameters.
PARTS = {
    "claude": ("$.type", "$.message.role"), "openclaw": ("$.type", "$.message.role"),
    "codex": ("$.type", "$.payload.type", "$.payload.call_id", "$.payload.name", "$.payload.output"),
}


def time_at(v: Column, path: str) -> Column:
    """The path's time and whether it has no zone."""
    kind, text = kind_at(v, path), text_at(v, path)
    number = kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE")
    own, naive = vendor_timestamp(F.when(~text.rlike(r"^\s*\d+\s*$"), text))
    own = F.when(number, F.timestamp_millis(F.try_variant_get(v, path, "double").try_cast("bigint"))).otherwise(own)
    return F.struct(own.alias("own"), F.coalesce(naive, F.lit(False)).alias("naive"))


def line_time(*times: Column) -> tuple[Column, Column]:
    """(time, whether it is unsure) of time_at(): the first path with a time decides; one without a zone ends the search."""
    found, unsure = F.lit(None).cast("timestamp"), F.lit(False)
    for t in reversed(times):
        own, naive = t["own"], t["naive"] & t["own"].isNull()
        found, unsure = F.when(own.isNotNull(), own).when(~naive, found), F.when(own.isNotNull(), False).when(naive, True).otherwise(unsure)
    return found, unsure


def classified(lines: DataFrame, client: str) -> DataFrame:
    """All events of each line, in order: event_no, event_type, event_key, event_at, confidence, lossiness beside the line's columns."""
    v, parts = F.col("_v"), [f"_part{i}" for i in range(len(PARTS[client]))]
    times = ("$.timestamp",) if client == "codex" else ("$.message.timestamp", "$.timestamp")
    rows = lines.withColumn("_v", json_value(F.col("value")))
    rows = rows.withColumns({c: text_at(v, path) for c, path in zip(parts, PARTS[client], strict=True)} | {f"_time{i}": time_at(v, path) for i, path in enumerate(times)})
    time, unsure = line_time(*(F.col(f"_time{i}") for i in range(len(times))))
    rows = rows.select(*lines.columns, time.alias("event_at"), unsure.alias("_u"), is_object(v).alias("_o"), F.coalesce(CLIENTS[client](v, *map(F.col, parts)), nothing()).alias("_es"))
    unknown = F.array(event("schema_unknown", None, "low", "none"))
    missing = F.array(event("schema_unknown", None, "missing", "none"))
    events = F.when(~F.col("_o"), missing).when(F.size("_es") == 0, unknown).otherwise(F.col("_es"))
    rows = rows.select(*lines.columns, "event_at", "_u", F.posexplode(events).alias("event_no", "_e"))
    sure = F.coalesce("_e.confidence", F.when(F.col("_u"), "low").otherwise("high"))
    lossy = F.coalesce("_e.lossiness", F.when(F.col("_e.event_type") == "compaction", "compacted").when(F.col("_u"), "unknown").otherwise("none"))
    return rows.select(*lines.columns, "event_no", "_e.event_type", "_e.event_key", "event_at", sure.alias("confidence"), lossy.alias("lossiness"))


def session_meta(lines: DataFrame, client: str) -> DataFrame:
    """client_version, parent_session_id, closure_seen of each line."""
    v = json_value(F.col("value"))
    kind = text_at(v, "$.type")
    parent = F.lit(None).cast("string")
    closed = kind.isin("session_close", "session_end", "closed")
    if client == "claude":
        parent = filled_at(v, "$.parentSessionId", "$.parent_session_id", "$.message.parentSessionId", "$.message.parent_session_id")
    if client == "codex":
        closed = kind.isin(*CLOSING) | ((kind == "event_msg") & text_at(v, "$.payload.type").isin(*CLOSING))
    version = filled_at(v, "$.payload.version" if client == "codex" else "$.version")
    return lines.select(*lines.columns, version.alias("client_version"), parent.alias("parent_session_id"), F.coalesce(closed, F.lit(False)).alias("closure_seen"))

