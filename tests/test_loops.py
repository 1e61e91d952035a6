"""Loops on the lines of three clients against a plain walk over what the lines were made from."""

import hashlib
import json
import random

import pytest

from tracelake.operators import loops

SCHEMA = "session long, client string, event_id long, event_type string, event_key string, event_at string, value string, payload string, seq long"


def claude(kind, tool, name, args, text):
    if kind == "result":
        return {"message": {"content": [{"type": "tool_result", "tool_use_id": "other", "content": "no"}, {"type": "tool_result", "tool_use_id": tool, "content": [{"type": "text", "text": text}, "and more"]}]}}
    return {"message": {"content": [{"type": "text", "text": "x"}, {"type": "tool_use", "id": "other", "name": "Bash", "input": {"command": "no"}}, {"type": "tool_use", "id": tool, "name": name, "input": args}]}}


def codex(kind, tool, name, args, text):
    if kind == "result":
        return {"payload": {"type": "function_call_output", "call_id": tool, "output": f"Exit code: 0\nWall time: 1\nOutput:\n{text}\nand more"}}
    return {"payload": {"type": "function_call", "call_id": tool, "name": name, "arguments": json.dumps(args)}}


def openclaw(kind, tool, name, args, text):
    if kind == "result":
        return {"message": {"role": "toolResult", "toolCallId": tool, "content": [{"text": text}, {"text": "and more"}]}}
    return {"message": {"content": [{"type": "toolCall", "id": tool, "name": name, "arguments": args}]}}


CLIENTS = {"claude": claude, "codex": codex, "openclaw": openclaw}


def made(seed):
    """(rows, for each session its stream of (type, what repeats or None, id, outcome seen))."""
    rng = random.Random(seed)
    rows, streams, n = [], {}, 0
    for s in range(24):
        client = list(CLIENTS)[s % 3]
        stream, calls = [], []
        for t in range(70):
            n += 1
            tool, at = f"t{n}", f"2026-01-01T00:{t:02d}:00Z" if rng.random() < 0.95 else None
            pick = rng.random()
            if pick < 0.05:
                kind = rng.choice(["user_message", "compaction", "assistant_message"])
                rows.append((s, client, n, kind, None, at, "{}", None, 0))
                stream.append((at, n, kind, None, None))
                continue
            shell = pick < 0.7
            command, outcome = rng.choice(["make test", "make test", "make lint"]), rng.choice(["ok pid 1", "ok pid 22", None, "fail"] if pick < 0.3 else ["ok pid 1", "ok pid 7"])
            if shell:
                args = {"description": f"try {n}", "command": rng.choice([command, command.split()]), "cwd": "/w"}
                kind, name, what = "command_start", rng.choice(["Bash", "shell", "zsh"]), ("command_start", command, outcome and outcome.split(" pid")[0])
                form = isinstance(args["command"], list)
                what = (*what, form)
            else:
                args = dict(rng.sample([("path", "a"), ("n", 1), ("deep", {"x": None})], 3))
                kind, name = "tool_call", "Read"
                what = ("tool_call", name, outcome and outcome.split(" pid")[0])
            line = json.dumps(CLIENTS[client]("call", tool, name, args, None))
            broken = rng.random() < 0.04
            rows.append((s, client, n, kind, f"{kind}:{tool}", at, "{broken" if broken else line, None, 0))
            stream.append((at, n, kind, None if broken else what, None if broken else outcome))
            if outcome is not None:
                calls.append((s, client, 100_000 + n, "tool_result", f"tool_result:{tool}", at, json.dumps(CLIENTS[client]("result", tool, name, args, outcome)), None, 0))
        for i in range(2):  # known from a hook only: breaks what is around its time
            at = f"2026-01-01T00:{rng.randrange(70):02d}:00Z"
            rows.append((s, client, None, rng.choice(["command_start", "user_message"]), f"hook{i}", at, None, "{}", i))
            stream.append((at, None, rows[-1][3], None, i))
        rows += calls
        streams[s] = sorted(stream, key=lambda r: (r[0] is None, r[0] or "", r[1] is None, r[1] or r[4]))
    rng.shuffle(rows)
    return rows, streams


def plain(streams):
    out = []
    for s, stream in streams.items():
        for rule, least in loops.THRESHOLDS.items():
            run, now = [], None
            for _, event, kind, what, outcome in [*stream, (None, None, "user_message", None, None)]:
                if kind != rule and kind not in loops.BREAKERS:
                    continue
                if what is None or what != now:
                    if now is not None and len(run) >= least:
                        out.append((s, rule, len(run), run[0], run[-1], "high" if now[2] is not None else "medium"))
                    run, now = [], what
                if what is not None:
                    run.append(event)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_loops_equal_a_plain_walk(spark, seed):
    rows, streams = made(seed)
    got = loops.loops(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = plain(streams)
    assert len(want) > 20 and {w[1] for w in want} == set(loops.THRESHOLDS)
    assert sorted((r["session"], r["event_type"], r["count"], r["first_event_id"], r["last_event_id"], r["confidence"]) for r in got) == want
    hashed = "sha256:" + hashlib.sha256(b"make test").hexdigest()[:16]
    assert {r["fingerprint"][1] for r in got if r["event_type"] == "command_start"} >= {hashed}
    assert all(r["event_ids"][0] == r["first_event_id"] and len(r["event_ids"]) == r["count"] for r in got)


def test_single_lines(spark):
    """Signatures and outcomes of the shapes that the walk above doesn't have."""
    bash = {"message": {"role": "bashExecution", "command": "ls", "output": "at 2026-01-01T00:00:00Z in /tmp/a b/c  done"}}
    item = lambda **p: json.dumps({"payload": {"type": "custom_tool_call", **p}})
    out = lambda output: json.dumps({"payload": {"type": "custom_tool_call_output", "output": output}})
    rows = [
        ("claude", "command_start", None, json.dumps(bash)), ("codex", "command_start", "command_start:c", item(name="shell", arguments=" ls -l ")), ("codex", "tool_call", "tool_call:d", item(name="edit", arguments=" *** patch ")),
        ("codex", "tool_call", "tool_call:e", item(name="sh", arguments="{}")), ("codex", "command_start", "command_start:f", item(name="shell", arguments=3)), ("codex", "tool_result", "tool_result:c", out("Exit code: 0\nno mark")),
        ("codex", "tool_result", "tool_result:d", out('{"output": "in"}')), ("openclaw", "command_start", "command_start:g", json.dumps({"message": {"content": [{"type": "toolCall", "id": "g", "name": "bash", "input": None, "arguments": {"command": "x"}}]}})),
        ("claude", "user_message", None, "{}"),
    ]
    df = spark.createDataFrame([(1, c, i, t, k, f"{i:02d}", v, None, 0) for i, (c, t, k, v) in enumerate(rows)], SCHEMA)
    got = {r["event_id"]: r["fingerprint"] for r in loops.fingerprints(df).collect()}
    h = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()[:16]
    assert got[0] == ["command_start", h("ls"), h("command:ls"), "present", h("at <TS> in <PATH> done")]
    assert got[1] == ["command_start", h("ls -l"), h("ls -l"), "missing", ""]
    assert got[2] == ["tool_call", h("edit"), h("*** patch"), "present", h("in")]
    assert got[3] is None and got[4] is None and got[7] is None and got[8] is None
    df = spark.createDataFrame([(1, "claude", 1, "command_start", None, "1", "{}", json.dumps(bash), 0)], SCHEMA)
    assert loops.fingerprints(df).first()["fingerprint"][1] == h("ls")
    assert loops.loops(spark.createDataFrame([], SCHEMA)).count() == 0
