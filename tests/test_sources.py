import json

import pytest
from pyspark.sql import functions as F

from tracelake.functions import variant
from tracelake.functions.text import shannon_entropy
from tracelake.plans import catalog
from tracelake.sources import events, jsonl, store
from tracelake.streaming import ingest


def lines(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


def test_lines_break_at_line_feeds_only(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes('{"type":"x y"}\r\n\n{"type":"z"}'.encode())
    got = jsonl.parsed(jsonl.read_lines(spark, str(tmp_path)), "type string")
    assert sorted(r["j"]["type"] for r in got.collect()) == ["x y", "z"]


def test_broken_lines(spark):
    df = lines(spark, [{"type": "user"}, "{broken", "[1]", {"type": "novel"}])
    got = [(r["event_type"], r["confidence"]) for r in events.classified(df, "claude").collect()]
    assert got == [("schema_unknown", "low"), ("schema_unknown", "missing"), ("schema_unknown", "missing"), ("schema_unknown", "low")]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        jsonl.parsed(df.where("value like '{broken%'"), "type string", strict=True).collect()


def test_every_event_of_a_line(spark):
    blocks = [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "t1", "name": "Read"}, {"type": "tool_use", "id": "t2", "name": "apply-patch"}, {"type": "tool_use", "name": "Bash"}]
    rows = [
        {"type": "assistant", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "assistant", "content": blocks}},
        {"type": "user", "timestamp": "2026-01-01T00:00:00", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1"}, {"type": "text", "text": "go"}]}},
        {"type": "user", "message": {"role": "bashExecution", "command": "ls", "output": "a", "exitCode": 0}}, {"type": "compaction"}, {"type": "assistant", "message": {"content": "x"}}, "{broken", "[1]",
    ]
    df = lines(spark, rows).coalesce(1)
    got = [(r["event_type"], r["event_key"], r["confidence"], r["lossiness"]) for r in events.classified(df, "claude").collect()]
    sure = ("high", "none")
    assert got == [
        ("assistant_message", None, *sure), ("tool_call", "tool_call:t1", *sure), ("file_read", "file_read:t1", *sure), ("tool_call", "tool_call:t2", *sure), ("patch", "patch:t2", *sure), ("tool_call", None, *sure), ("command_start", None, *sure),
        ("user_message", None, "low", "unknown"), ("tool_result", "tool_result:t1", "low", "unknown"), ("command_start", None, *sure), ("stdout_chunk", None, "low", "unknown"), ("command_exit", None, *sure),
        ("compaction", None, "high", "compacted"), ("schema_unknown", None, "low", "none"), ("schema_unknown", None, "missing", "none"), ("schema_unknown", None, "missing", "none"),
    ]
    item = lambda **p: {"type": "response_item", "payload": p}
    rows = [item(type="function_call", call_id="c", name="shell"), item(type="function_call_output", call_id="c", output="Exit code: 0\nok"), item(type="custom_tool_call", name="edit"), item(type="reasoning"), item(type="message"), {"type": "turn_context"}, {"type": "event_msg", "payload": {"type": "agent_message"}}]
    got = [(r["event_type"], r["event_key"]) for r in events.classified(lines(spark, rows).coalesce(1), "codex").collect()]
    assert got == [("tool_call", "tool_call:c"), ("command_start", "command_start:c"), ("tool_result", "tool_result:c"), ("command_exit", "command_exit:c"), ("tool_call", None), ("file_write", None), ("assistant_message", None), ("schema_unknown", None), ("schema_unknown", None), ("assistant_message", None)]


def test_exit_codes_and_shapes(spark):
    item = lambda output: {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": output}}
    outputs = ["a\nExit code: 1", "Exit code 1", '{"metadata":{"exit_code":null}}', '{"metadata":{}}', '{"metadata":3}', [{"type": "input_text", "text": "x\r\nExit code: 0"}], [{"type": "text", "text": "Exit code: 0"}, 3], None, 5]
    got = events.classified(lines(spark, [item(o) for o in outputs]).withColumn("n", F.monotonically_increasing_id()).coalesce(1), "codex").collect()
    exits = [any(r["event_type"] == "command_exit" for r in got if r["n"] == n) for n in sorted({r["n"] for r in got})]
    assert exits == [True, False, True, False, False, True, False, False, False]


def test_openclaw_lines(spark):
    m = lambda **x: {"type": "message", "timestamp": 1767225600000, "message": x}
    rows = [
        {"type": "session", "version": "2"}, m(role="user", content=[{"type": "image"}, {"type": "odd", "text": "hi"}]), m(role="user", content=" "), m(role="assistant", content="text"),
        m(role="assistant", content=[{"type": "thinking", "thinking": "hm"}, {"type": "toolCall", "id": "k", "name": "multi-edit"}, {"type": "tool_use", "id": "z", "name": "bash"}, 3]), m(role="toolResult", toolCallId=" "),
        m(role="bashExecution", command="ls", exitCode=None), m(role="approval_decision"), m(role="other"), {"type": "message", "message": 3}, {"type": "compaction", "timestamp": "2026-01-01T00:00:00"}, {"type": "closed"}, {"type": 5},
    ]
    df = lines(spark, rows).coalesce(1)
    got = [(r["event_type"], r["event_key"], r["confidence"], r["lossiness"]) for r in events.classified(df, "openclaw").collect()]
    sure, unknown = ("high", "none"), ("schema_unknown", None, "low", "none")
    assert got == [
        ("session_open", None, *sure), ("user_message", None, *sure), unknown, unknown, ("assistant_message", None, *sure), ("tool_call", "tool_call:k", *sure), ("tool_result", None, *sure), ("command_start", None, *sure),
        ("approval_decision", None, *sure), unknown, unknown, ("compaction", None, "low", "compacted"), unknown, unknown,
    ]
    meta = [(r["client_version"], r["closure_seen"]) for r in events.session_meta(df, "openclaw").collect()]
    assert meta[0] == ("2", False) and meta[-2] == (None, True)
    df = lines(spark, [{"type": "user", "parentSessionId": " ", "message": {"parent_session_id": "p"}, "version": " "}, {"type": "event_msg", "payload": {"type": "session_end", "version": "9"}}])
    assert [r["parent_session_id"] for r in events.session_meta(df, "claude").collect()] == ["p", None]
    assert [(r["client_version"], r["closure_seen"]) for r in events.session_meta(df, "codex").collect()] == [(None, False), ("9", True)]


def test_times_of_lines(spark):
    """The message's time comes first; one without a zone ends the search; digits in quotes are no time."""
    rows = [
        {"type": "compaction", "timestamp": "2026-01-01T02:00:00+02:00", "message": {"timestamp": 1767225600000}}, {"type": "compaction", "timestamp": 1767225600000, "message": {"timestamp": "2026-01-01T00:00:00"}},
        {"type": "compaction", "timestamp": 1767225600000, "message": {"timestamp": "never"}}, {"type": "compaction", "timestamp": "1767225600000"}, {"type": "compaction", "timestamp": None},
    ]
    got = events.classified(lines(spark, rows).coalesce(1), "claude").select(F.unix_seconds("event_at"), "confidence").collect()
    assert [tuple(r) for r in got] == [(1767225600, "high"), (None, "low"), (1767225600, "high"), (None, "high"), (None, "high")]


def test_canonical_json_and_typed_values(spark):
    df = spark.createDataFrame([('{"b": [1.0, {"y": null, "x": "\u00e9"}], "a": true}',), ('{ "a":true,"b":[1,{"x":"é","y":null}]}',), ("{bad",), (None,)], "v string")
    got = [r[0] for r in df.select(variant.canonical(F.col("v"))).collect()]
    assert got == ['{"a":true,"b":[1,{"x":"é","y":null}]}'] * 2 + [None, None]
    values = {"7": 7, "7.0": 7, "7e2": 700, "7.5": None, "true": None, '"7"': None, "null": None, "[7]": None, "-3": -3, "9007199254740993": 9007199254740993}
    df = spark.createDataFrame([(f'{{"n": {v}}}',) for v in values], "v string")
    assert [r[0] for r in df.select(variant.integer_at(variant.json_value(F.col("v")), "$.n")).collect()] == list(values.values())
    df = spark.createDataFrame([('{"a": 1, "b": " ", "c": "x"}',)], "v string")
    assert df.select(variant.filled_at(variant.json_value(F.col("v")), "$.a", "$.b", "$.c")).first()[0] == "x"


def test_calls_of_lines_with_equal_or_no_times(spark):
    call = lambda i, n: {"type": "tool_use", "id": i, "name": n, "input": {"p": 1}}
    rows = [
        {"type": "assistant", "timestamp": "1", "sessionId": "s", "message": {"content": [call("c1", "Read"), {"type": "thinking", "thinking": "why"}]}}, {"type": "assistant", "timestamp": "1", "sessionId": "s", "message": {"content": [{"type": "text", "text": "b"}, call("c2", "Bash"), call("c0", "Edit")]}},
        {"type": "assistant", "sessionId": "s", "message": {"content": [call("c3", "Read")]}}, {"type": "assistant", "message": {"content": [call("c1", "Read")]}}, {"type": "user", "sessionId": "s", "message": {"content": [{"type": "tool_result", "tool_use_id": i, "content": f"of {i}"} for i in ("c1", "c3")]}},
    ]
    got = jsonl.claude_messages(lines(spark, rows).coalesce(1)).orderBy("line").collect()
    assert [[tuple(t) for t in r["tools"]] for r in got] == [[("c1", "Read", "of c1")], [("c2", "Bash", None), ("c0", "Edit", None)], [("c3", "Read", "of c3")], [("c1", "Read", None)]]
    assert [(r["text"], r["thinking"]) for r in got[:2]] == [("", "why"), ("b", "")]


def test_tool_results_join_their_calls(spark):
    rows = [
        {"type": "user", "timestamp": "1", "sessionId": "s", "message": {"role": "user", "content": "hi"}},
        {"type": "assistant", "timestamp": "2", "sessionId": "s", "message": {"role": "assistant", "model": "m", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"p": 1}}], "usage": {"input_tokens": 3, "output_tokens": 4}}},
        {"type": "user", "timestamp": "3", "sessionId": "s", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "done"}]}},
        {"type": "assistant", "timestamp": "4", "sessionId": "s", "message": {"role": "assistant", "model": "m", "content": [{"type": "tool_use", "id": "t2", "name": "Bash", "input": {}}], "usage": {"input_tokens": 5, "output_tokens": 6}}},
    ]
    df = lines(spark, rows)
    got = {r["at"]: r for r in jsonl.claude_messages(df).collect()}
    assert set(got) == {"1", "2", "4"}
    assert [tuple(t) for t in got["2"]["tools"]] == [("t1", "Read", "done")]
    assert [tuple(t) for t in got["4"]["tools"]] == [("t2", "Bash", None)]
    assert tuple(jsonl.claude_usage(df).first()) == ("s", 8, 10, 0, 0)


def test_replay_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")
    path = f"{tmp_path}/t"
    assert store.append_new(df, path, ["id"]).count() == 2
    assert store.append_new(df.union(spark.createDataFrame([(3, "c")], df.schema)), path, ["id"]).count() == 3


def test_stream_of_many_files_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/e")
    events.limit(50).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")  # a replayed file
    got = ingest.ingest(spark, f"{tmp_path}/e", ["event_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ingest.summary(events).collect()))


def test_upsert_keeps_columns_only_of_the_same_revision(spark):
    old = spark.createDataFrame([(1, "r", 5), (2, "r", 6), (3, "r", 7)], "id long, rev string, score int")
    new = spark.createDataFrame([(1, "r", None), (2, "q", None), (4, "r", 9)], old.schema)
    got = sorted(map(tuple, store.snapshot_upsert(old, new, "id", "rev", ["score"]).collect()))
    assert got == [(1, "r", 5), (2, "q", None), (3, "r", 7), (4, "r", 9)]


def test_chunks_overlap_and_cover(spark, medium):
    sizes = {}
    for r in spark.read.parquet(f"{medium}/conversations.parquet").orderBy("conv_id", "turn").collect():
        sizes.setdefault(r["conv_id"], []).append(len(r["text"]))
    chunks = {}
    for r in catalog.QUERIES["judge_chunks"](spark, medium).orderBy("conv_id", "first").collect():
        chunks.setdefault(r["conv_id"], []).append((r["first"], r["last"], r["chars"]))
    assert set(chunks) == set(sizes)
    for conv, own in chunks.items():
        assert own[0][0] == 0 and own[-1][1] == len(sizes[conv])
        for first, last, chars in own:
            assert chars == sum(sizes[conv][first:last]) and (chars <= 1500 or last == first + 1)
        for (a, b, _), (c, _, _) in zip(own, own[1:], strict=False):
            assert a < c <= b and c >= b - 2


def test_high_entropy_equals_the_formula(spark, small):
    import math
    import re
    from collections import Counter

    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = {x for t in texts for x in re.findall(r"[A-Za-z0-9+/_=-]{20,}", t or "")}
    entropy = lambda s: -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())
    want = sorted(((-round(entropy(x), 9), x) for x in found))[:15]
    got = [(-round(r["entropy"], 9), r["candidate"]) for r in catalog.QUERIES["high_entropy_tokens"](spark, small).collect()]
    assert sorted(got) == want
    assert spark.range(1).select(shannon_entropy(F.lit(""))).first()[0] in (0.0, -0.0)


def test_a_line_is_parsed_once(spark):
    """Spark computes what branches name anew in each of them."""
    from tracelake.sources import events

    lines = spark.createDataFrame([('{"type":"session_meta"}',), ("[1]",), ("{broken",)], "value string")
    for client in events.CLIENTS:
        plan = events.classified(lines, client)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == (2 if client == "codex" else 1)  # outputs of codex are parsed themselves
    got = {(r["value"], r["event_type"], r["confidence"]) for r in events.classified(lines, "codex").collect()}
    assert got == {('{"type":"session_meta"}', "session_open", "high"), ("[1]", "schema_unknown", "missing"), ("{broken", "schema_unknown", "missing")}
