"""Trace archives: json, jsonl, ndjson and log files of unknown layout, loose or inside zip files.

``files`` lists a folder, ``members`` reads the zip directories, ``texts`` reads
the members themselves, each by random access, so that a task holds one member
(25 MiB at most) and never an archive. Members are dealt to tasks in parts of
64 MiB, also those of one archive. All probing is done on VARIANT columns:

* a text is one JSON value, or else a value a line; what stands before the
  first bracket of a line is left out (log heads);
* a list of messages is a session, so is an object with a list under one of
  ``MESSAGES``; lists under one of ``LISTS``, and other lists, are opened, up to
  ``LEVELS`` deep (what lies deeper is reported);
* messages that stand alone in their lines come together by their session's id;
* an id that a project has twice stays with the first session in the order of
  paths and places; the others' ids are digests of id and place.

What can't be read is reported with its reason. Spark lists no folders whose
names begin with a dot: name such folders themselves.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.time import vendor_timestamp
from tracelake.functions.variant import at, filled_at, integer_at, is_object, items_at, json_value, once, text_at

MAX_FILE, MAX_MEMBER, PART, LEVELS = 100 << 20, 25 << 20, 64 << 20, 5

# Suffixes and names that traces use.
TRACES = ("json", "jsonl", "ndjson", "log")
MESSAGES = ("messages", "messageList", "chatMessages", "conversation", "history", "records", "dialogue", "turns")
LISTS = ("sessions", "conversations", "tasks", "items", "data", "list")
GROUP_IDS = ("session_id", "sessionId", "conversation_id", "conversationId", "task_id", "taskId", "threadId")
SESSION_IDS = ("session_id", "sessionId", "conversation_id", "conversationId", "task_id", "taskId", "id", "uuid")
ROLES = ("role", "author", "sender", "type", "event")
USERS = ("user", "human", "customer", "client", "request", "user_message")
ASSISTANTS = ("assistant", "ai", "agent", "bot", "workbuddy", "answer", "assistant_message", "model")
TEXTS = ("content", "text", "message", "prompt", "answer", "response")
OUTPUTS = ("output", "result")
INNER_TEXTS = ("text", "content", "markdown", "value", "body")
THOUGHTS = ("thinking", "reasoning", "thought", "plan")
TOOL_LISTS = ("tool_uses", "toolUses", "tool_calls", "toolCalls", "tools")
TOOL_NAMES = ("tool", "toolName", "name", "functionName")
TOOL_INPUTS = ("input", "arguments", "args", "parameters")
MODELS = ("model", "modelName", "model_id", "modelId")
FOLDERS = ("cwd", "workspace", "workspacePath", "workdir")
BRANCHES = ("git_branch", "gitBranch", "branch")
STARTS = ("start_time", "startTime", "createdAt", "created_at", "timeCreated")
ENDS = ("end_time", "endTime", "updatedAt", "finishedAt", "lastActivityAt")
TIMES = ("timestamp", "createdAt", "created_at", "time", "timeCreated")
INPUTS = ("input_tokens", "inputTokens", "prompt_tokens", "promptTokens")
OUTPUT_TOKENS = ("output_tokens", "outputTokens", "completion_tokens", "completionTokens")

#: What stands before a path's first folder in a URI.
_PREFIX = r"^[a-z][a-z0-9+.-]*:(//[^/]*)?/+"


def _located(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if path.startswith("file:") or "://" not in path:
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(path)


def _suffix(name: str) -> str:
    return name.rpartition(".")[2].lower() if "." in name else ""


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, project, suffix, length of the traces and archives below a folder; their content isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    bare = F.regexp_replace("path", _PREFIX, "/")
    below = F.substring(bare, len(re.sub(_PREFIX, "/", folder.rstrip("/"))) + 2, 1 << 30)
    inner = F.split(below, "/")
    rows = found.withColumn("suffix", suffix).where(F.col("suffix").isin(*TRACES, "zip"))
    return rows.select("path", F.when(F.size(inner) > 1, inner[0]).otherwise("manual").alias("project"), "suffix", "length")


def _directory(path: str) -> list[tuple]:
    out, read = [], 0
    system, name = _located(path)
    try:
        with system.open_input_file(name) as f, zipfile.ZipFile(f) as archive:
            for number, m in enumerate(archive.infolist()):
                if m.is_dir() or _suffix(m.filename) not in TRACES:
                    continue
                problem = "too large" if m.file_size > MAX_MEMBER else "encrypted" if m.flag_bits & 1 else None
                out.append((m.filename, number, read // PART, problem))
                read += m.file_size if problem is None else 0
    except (zipfile.BadZipFile, ValueError):
        out = [(None, None, 0, "no zip archive")]
    return out


def members(found: DataFrame) -> DataFrame:
    """path, project, member, number, part, problem: a row for each trace, loose ones with a null member."""
    large = F.when(F.col("length") > MAX_FILE, "too large")

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, project in zip(frame["path"], frame["project"]):
                rows = [(path, project, *m) for m in _directory(path)]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "project", "member", "number", "part", "problem"]).astype({"number": "Int64"})

    schema = "path string, project string, member string, number long, part long, problem string"
    zipped = found.where((F.col("suffix") == "zip") & large.isNull()).select("path", "project").mapInPandas(listed, schema)
    plain = found.where((F.col("suffix") != "zip") | large.isNotNull())
    none = lambda kind: F.lit(None).cast(kind)
    return zipped.unionByName(plain.select("path", "project", none("string").alias("member"), none("long").alias("number"), F.lit(0).cast("long").alias("part"), large.alias("problem")))


def texts(listed: DataFrame) -> DataFrame:
    """path, project, member, text, problem of the members; a damaged one has its reason instead of a text."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, rows in frame.groupby("path", sort=False):
                system, name = _located(path)
                with system.open_input_file(name) as f:
                    archive, wanted = None, rows.itertuples()
                    if rows["number"].notna().any():
                        archive = zipfile.ZipFile(f)
                    for r in wanted:
                        text = problem = None
                        try:
                            data = f.read() if archive is None else archive.read(archive.infolist()[int(r.number)])
                            text = data.decode("utf-8", "replace")
                        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError):
                            problem = "damaged"
                        yield pd.DataFrame([(path, r.project, r.member, text, problem)], columns=["path", "project", "member", "text", "problem"])

    schema = "path string, project string, member string, text string, problem string"
    good = listed.where("problem IS NULL").select("path", "project", "member", "number", "part").repartition("path", "part")
    bad = listed.where("problem IS NOT NULL").select("path", "project", "member", F.lit(None).cast("string").alias("text"), "problem")
    return good.mapInPandas(read, schema).unionByName(bad)


def paths(names: tuple[str, ...]) -> list[str]:
    return [f"$.{n}" for n in names]


def first_of(value: Column, names: tuple[str, ...], found) -> Column:
    """The first that isn't null of ``found`` over the values under the names."""
    each = F.transform(F.array(*(at(value, p) for p in paths(names))), found)
    return F.get(F.filter(each, lambda x: x.isNotNull()), 0)


def first_filled(value: Column, names: tuple[str, ...]) -> Column:
    return F.trim(first_of(value, names, lambda x: filled_at(x, "$")))


def full_list(value: Column) -> Column:
    return once(items_at(value, "$"), lambda items: F.when(F.size(items) > 0, items))


def identifier(value: Column, names: tuple[str, ...]) -> Column:
    return first_of(value, names, lambda x: F.coalesce(F.trim(filled_at(x, "$")), integer_at(x, "$").cast("string")))


def instant(value: Column, names: tuple[str, ...]) -> Column:
    return vendor_timestamp(first_of(value, names, lambda x: F.coalesce(text_at(x, "$"), integer_at(x, "$").cast("string"))))[0]


def role(value: Column) -> Column:
    return once(F.lower(first_filled(value, ROLES)), lambda said: (
        F.when(said.isin(*USERS), "user").when(said.isin(*ASSISTANTS), "assistant").when(said.contains("user"), "user")
        .when(said.rlike("assistant|agent|bot|reply|answer"), "assistant")
    ))


def is_message(value: Column) -> Column:
    has = reduce(lambda a, b: a | b, (at(value, p).isNotNull() for p in paths(TEXTS)))
    return is_object(value) & (role(value).isNotNull() | has)


def plain_text(value: Column, depth: int = 3) -> Column:
    """A string, the first text of an object, or the texts of a list a blank line apart; stripped, null where there is none."""
    strip = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    own = once(strip(text_at(value, "$")), lambda said: F.when(said != "", said))
    if depth == 0:
        return own
    inner = first_text(value, INNER_TEXTS, depth - 1)
    listed = F.filter(F.transform(items_at(value, "$"), lambda x: plain_text(x, depth - 1)), lambda t: t.isNotNull())
    return F.coalesce(own, F.when(is_object(value), inner), once(listed, lambda parts: F.when(F.size(parts) > 0, strip(F.array_join(parts, "\n\n")))))


def first_text(value: Column, names: tuple[str, ...], depth: int = 3) -> Column:
    return first_of(value, names, lambda x: plain_text(x, depth))


def tool_uses(value: Column) -> Column:
    """(name, input) of each call of a message; a message that names a tool itself is a call."""
    none = F.expr("CAST(array() AS ARRAY<VARIANT>)")
    lists = F.flatten(F.array(*(F.coalesce(items_at(value, p), none) for p in paths(TOOL_LISTS))))
    listed = F.filter(lists, is_object)
    has = lambda *names: reduce(lambda a, b: a | b, (at(value, p).isNotNull() for p in paths(names)))
    itself = has("tool", "toolName", "functionName") | (has("name") & has(*TOOL_INPUTS))
    calls = F.when(F.size(listed) > 0, listed).when(itself, F.array(value)).otherwise(none)
    given = lambda x: F.coalesce(*(at(x, p) for p in paths(TOOL_INPUTS)))
    return F.transform(calls, lambda x: F.struct(F.coalesce(first_filled(x, TOOL_NAMES), F.lit("tool")).alias("name"), F.to_json(given(x)).alias("input")))


def fragment(line: Column) -> Column:
    return F.coalesce(json_value(line), json_value(F.regexp_extract(line, r"(?s)[{\[].*", 0)))


def values(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, project, member, place, value of every JSON value; path, member, problem of what gives none)."""
    lines = F.transform(F.split("text", r"\r\n|\r|\n"), fragment)
    whole = once(json_value("text"), lambda v: F.when(v.isNotNull(), F.array(v)).otherwise(lines))
    rows = read.withColumn("_v", F.when(F.col("text").isNotNull(), whole))
    empty = F.col("text").rlike(r"\S") & ~F.exists("_v", lambda v: v.isNotNull())
    told = read.where("problem IS NOT NULL").select("path", "member", "problem")
    mute = rows.where(empty).select("path", "member", F.lit("no JSON").alias("problem"))
    found = rows.select("path", "project", "member", F.posexplode("_v").alias("line", "value")).where("value IS NOT NULL")
    return found.select("path", "project", "member", F.array("line").alias("place"), "value"), told.unionByName(mute)


def opened(found: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(values with ``alone`` (a message that stands for itself) or ``items`` (a session's messages), problems)."""
    own = full_list(F.col("value"))
    messages = once(own, lambda o: F.coalesce(F.when(F.forall(o, is_message), o), first_of(F.col("value"), MESSAGES, full_list)))
    nested = F.coalesce(items_at(F.col("value"), "$"), first_of(F.col("value"), LISTS, full_list))

    def probed(rows: DataFrame) -> DataFrame:
        """Adds ``items`` and ``_n``, what a value opens into. A value that was not opened is as it was: it isn't looked at again."""
        rows = rows.withColumn("items", F.when(F.col("new"), messages).otherwise(F.col("items")))
        return rows.withColumn("_n", F.when(F.col("new") & F.col("items").isNull(), nested))

    rows = probed(found.withColumns({"top": F.lit(True), "new": F.lit(True), "items": F.lit(None).cast("array<variant>")}))
    for _ in range(levels):
        items = F.coalesce("_n", F.array("value"))
        rows = rows.select("path", "project", "member", "place", (F.col("top") & F.col("_n").isNull()).alias("top"), F.col("_n").isNotNull().alias("new"), "items", F.posexplode(items).alias("_p", "value"))
        rows = probed(rows.select("path", "project", "member", F.concat("place", F.array("_p")).alias("place"), "top", "new", "items", "value"))
    deep = rows.where(F.size("_n") > 0).select("path", "member", F.lit("nested too deeply").alias("problem")).distinct()
    alone = F.col("top") & F.col("items").isNull() & is_message(F.col("value"))
    return rows.withColumn("alone", alone).where("alone OR items IS NOT NULL").drop("top", "new", "_n"), deep


def digest_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def raw_messages(sessions: DataFrame) -> DataFrame:
    """A row for each message with its session's slot (unique within a member, ordered by place) and own columns."""
    origin = F.concat_ws("#", "path", "member")
    padded = F.array_join(F.transform("place", lambda p: F.lpad(p.cast("string"), 10, "0")), ".")
    v, alone = F.col("value"), F.col("alone")
    group = F.coalesce(identifier(v, GROUP_IDS), digest_id(origin, F.lit("events")))
    listed = F.coalesce(identifier(v, SESSION_IDS), digest_id(origin, F.when(is_object(v), "session").otherwise("list")))
    meta = lambda c: F.when(~alone, c)
    rows = sessions.select(
        "path", "project", "member", F.when(alone, F.concat(F.lit("g."), group)).otherwise(F.concat(F.lit("c."), padded)).alias("slot"), F.when(alone, group).otherwise(listed).alias("given_id"),
        meta(first_filled(v, MODELS)).alias("model"), meta(first_filled(v, FOLDERS)).alias("cwd"), meta(first_filled(v, BRANCHES)).alias("branch"), meta(instant(v, STARTS)).alias("started_at"), meta(instant(v, ENDS)).alias("ended_at"),
        "place", F.when(alone, F.array(v)).otherwise(F.col("items")).alias("items"),
    )
    kept = [c for c in rows.columns if c not in ("place", "items")]
    return rows.select(*kept, "place", F.posexplode("items").alias("_p", "raw")).select(*kept, F.concat("place", F.array("_p")).alias("place"), "raw").where(is_object(F.col("raw")))


def messages(sessions: DataFrame) -> DataFrame:
    raw = F.col("raw")
    rows = raw_messages(sessions).withColumn("tools", tool_uses(raw)).withColumn("text", first_text(raw, TEXTS + OUTPUTS)).withColumn("thinking", first_filled(raw, THOUGHTS))
    rows = rows.withColumn("role", F.coalesce(role(raw), F.when(F.size("tools") > 0, "assistant"))).where("role IS NOT NULL AND (text IS NOT NULL OR thinking IS NOT NULL OR size(tools) > 0)")
    usage = F.when(is_object(at(raw, "$.usage")), at(raw, "$.usage")).otherwise(raw)
    tokens = lambda names: F.coalesce(first_of(usage, names, lambda x: integer_at(x, "$")), F.lit(0))
    return rows.withColumns({
        "at": instant(raw, TIMES), "said_model": first_filled(raw, MODELS), "input_tokens": tokens(INPUTS),
        "output_tokens": tokens(OUTPUT_TOKENS),
    }).drop("raw")


def headers(said: DataFrame) -> DataFrame:
    """A row for each session: ids, what describes it, times, numbers of messages, tools and tokens."""
    timed = F.when(F.col("at").isNotNull(), F.col("place"))
    n = lambda c: F.count(F.when(c, 1))
    found = said.groupBy("path", "project", "member", "slot", "given_id").agg(
        F.coalesce(F.max("model"), F.min_by("said_model", F.when(F.col("said_model").isNotNull(), F.col("place"))), F.lit("unknown")).alias("model"), F.max("cwd").alias("cwd"), F.max("branch").alias("branch"),
        F.coalesce(F.max("started_at"), F.min_by("at", timed)).alias("started_at"), F.coalesce(F.max_by("at", timed), F.max("ended_at")).alias("ended_at"),
        n(F.col("role") == "user").alias("user_messages"), n(F.col("role") == "assistant").alias("assistant_messages"), F.sum(F.size("tools")).alias("tool_uses"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
    )
    spot = F.struct("path", F.coalesce("member", F.lit("")).alias("member"), "slot")
    first = found.groupBy("project", "given_id").agg(F.min(spot).alias("_first"))
    unlike = digest_id(F.col("given_id"), F.concat_ws("#", "path", "member"), F.col("slot"))
    both = found.withColumn("_spot", spot).join(first, ["project", "given_id"])
    return both.withColumn("session_id", F.when(F.col("_spot") == F.col("_first"), F.col("given_id")).otherwise(unlike)).drop("_spot", "_first")


def imported(spark: SparkSession, folder: str, write) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, their messages, problems) of a folder; ``write(df, name)`` keeps what is used more than once."""
    read = write(texts(members(files(spark, folder))), "texts")
    found, unread = values(read)
    sessions, deep = opened(found)
    said = write(messages(sessions), "messages")
    heads = headers(said)
    key = ["path", "member", "slot"]
    same = reduce(lambda a, b: a & b, (F.col(f"m.{c}").eqNullSafe(F.col(f"h.{c}")) for c in key))
    named = said.alias("m").join(heads.select(*key, "session_id").alias("h"), same).select("h.session_id", "m.project", "m.path", "m.member", "m.place", "m.role", "m.text", "m.thinking", "m.tools", "m.at")
    return heads.drop("given_id"), named, unread.unionByName(deep)


def write_archives(rows: DataFrame, folder: str) -> int:
    """Writes (archive, member, text) as zip files, one a task at a time; returns their number.

    An archive's members must fit into memory together. A repeated task writes
    the same file again and moves it into place.
    """

    def zipped(frame: pd.DataFrame) -> pd.DataFrame:
        name = f"{folder}/{frame['archive'].iloc[0]}.zip"
        system, path = _located(name)
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
            for member, text in sorted(zip(frame["member"], frame["text"])):
                archive.writestr(zipfile.ZipInfo(member), text, zipfile.ZIP_DEFLATED)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        attempt = f"{path}.{uuid4().hex}"
        with system.open_output_stream(attempt) as f:
            f.write(held.getvalue())
        system.move(attempt, path)
        return pd.DataFrame({"path": [name]})

    return rows.groupBy("archive").applyInPandas(zipped, "path string").count()
