"""Collapsed chains of calls and polls against a plain loop; cleaning rules."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from tracelake.operators import training

SCHEMA = "session long, turn long, place long, tool string, input string, output string, status string"


def plain(rows):
    out = []
    for key in sorted({r[:2] for r in rows}):
        pending, items = {}, []
        tc = lambda place, key=key: "tc_" + hashlib.sha256(f"{key[0]}|{key[1]}|{place}".encode()).hexdigest()[:8]
        for _, _, place, tool, input_, output, status in sorted(r for r in rows if r[:2] == key):
            sid = json.loads(input_).get("sessionId")
            if tool == "process" and sid:
                if sid in pending:
                    text = output or ""
                    lost = text in ("", f"No session found for {sid}")
                    items.append(("tool_result", tc(pending.pop(sid)), None if lost else text, "lost" if lost else "success"))
                continue
            items.append(("tool_call", tc(place), None, None))
            if output and output.startswith("Command still running (session "):
                pending[output.split("session ")[1].split(",")[0]] = place
            else:
                items.append(("tool_result", tc(place), output or "", status))
        items += [("tool_result", tc(place), None, "lost") for place in pending.values()]
        out += [(*key, *i) for i in items]
    return out


def test_interleaved_chains(spark):
    rng = random.Random(3)
    rows = []
    for s in range(30):
        for place in range(40):
            sid = f"s{rng.randrange(4)}"
            pick = rng.random()
            if pick < 0.4:
                rows.append((s, place // 20, place, "exec", '{"command": "a", "workdir": "/"}', rng.choice([f"Command still running (session {sid}, pid 3)", f"Command still running (session {sid}, pid 3)", "done", None]), "ok"))
            elif pick < 0.8:
                rows.append((s, place // 20, place, "process", json.dumps({"sessionId": sid}), rng.choice(["result", f"No session found for {sid}", None]), "ok"))
            else:
                rows.append((s, place // 20, place, rng.choice(["process", "read"]), "{}", "x", "odd"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = training.collapsed(df).orderBy("session", "turn", "place", "part").select("session", "turn", "type", "id", "output", "status").collect()
    assert list(map(tuple, got)) == plain(rows)
    assert training.collapsed(df.limit(0)).count() == 0


def test_cleaning(spark):
    rows = [("exec", '{"b": 1, "command": "x", "timeout": 3, "ask": null}', "│ a ┃\n╭──────╮\n──\n  │ b│\n\nend │"), ("process", '{"limit": 1, "workdir": "/"}', ""), ("read", '{"timeout": 1}', "─a──"), ("exec", "[1]", "plain")]
    df = spark.createDataFrame(rows, "tool string, input string, output string")
    got = df.select(training.clean_input(F.col("tool"), F.col("input")), training.clean_output(F.col("output"))).collect()
    assert [r[0] for r in got] == ['{"b":1,"command":"x"}', '{"workdir":"/"}', '{"timeout":1}', "[1]"]
    assert [r[1] for r in got] == ["a\n──\n  │ b\n\nend", "", "─a──", "plain"]
