"""Archives of traces: layouts, damaged and large members, repeated ids, loose files."""

import json
import uuid
import zipfile

import pytest

from tracelake.sources import archives


@pytest.fixture
def load(spark, tmp_path):
    def put(df, name):
        path = f"{tmp_path}/kept/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def run(prefix="file://"):
        heads, said, problems = archives.imported(spark, f"{prefix}{tmp_path}/in", put)
        by = {}
        for m in sorted(said.collect(), key=lambda m: (m.session_id, m.place)):
            by.setdefault(m.session_id, []).append(m)
        told = sorted((p.path.rpartition("/")[2], p.member, p.problem) for p in problems.collect())
        return {h.session_id: h for h in heads.collect()}, by, told

    (tmp_path / "in").mkdir()
    return tmp_path / "in", run


def zipped(path, members):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members:
            z.writestr(name, text)


def test_members_of_every_layout_become_sessions(load):
    folder, run = load
    whole = {"sessionId": "a", "model": "m1", "cwd": "/w", "createdAt": "2026-01-01T00:00:00Z", "messages": [{"role": "human", "content": " hi "}, {"role": "ai", "content": [{"type": "text", "text": "x"}, "y", {"body": ""}], "usage": {"inputTokens": 3, "completionTokens": 2}}]}
    lines = [{"session_id": 7, "role": "user", "text": "q"}, {"session_id": 8, "role": "user", "text": "other"}, {"session_id": 7, "event": "agent reply", "message": {"markdown": "r"}, "timestamp": 1767225600000, "modelId": "m2"}]
    nested = {"data": [{"conversations": [{"id": "n1", "turns": [{"prompt": "p", "sender": "client"}]}, {"id": "n2", "history": [{"toolName": "Run", "args": {"b": 1}}]}]}]}
    zipped(folder / "proj" / "x.zip", [("one.json", json.dumps(whole)), ("sub/two.jsonl", "\n".join(map(json.dumps, lines))), ("three.ndjson", "INFO 12:00 " + json.dumps(nested) + "\nnoise\n"), ("four.txt", "no trace")])
    (folder / "loose.log").write_text(json.dumps([{"role": "user", "content": "loose"}, {"role": "system", "content": "no"}]))
    heads, said, told = run()
    assert told == []
    loose = next(k for k, h in heads.items() if h.project == "manual")
    assert set(heads) == {"a", "7", "8", "n1", "n2", loose} and len(loose) == 16
    assert [(m.role, m.text) for m in said["a"]] == [("user", "hi"), ("assistant", "x\n\ny")]
    assert (heads["a"].model, heads["a"].cwd, heads["a"].input_tokens, heads["a"].output_tokens, heads["a"].project) == ("m1", "/w", 3, 2, "proj")
    assert [(m.role, m.text) for m in said["7"]] == [("user", "q"), ("assistant", "r")] and heads["7"].model == "m2" and heads["7"].started_at == heads["7"].ended_at is not None
    assert [(m.role, m.text) for m in said["n1"]] == [("user", "p")] and heads["n1"].model == "unknown"
    assert [(m.role, m.tools[0].name, m.tools[0].input) for m in said["n2"]] == [("assistant", "Run", '{"b":1}')] and heads["n2"].tool_uses == 1
    assert [m.text for m in said[loose]] == ["loose"]


def test_what_cannot_be_read_is_reported(load, monkeypatch):
    folder, run = load
    (folder / "bad.zip").write_bytes(b"PK no archive")
    good = json.dumps({"id": "g", "messages": [{"role": "user", "content": "ok"}]})
    with zipfile.ZipFile(folder / "d.zip", "w") as z:
        z.writestr("a.json", good)
        z.writestr("b.json", good.replace('"g"', '"h"'))
    data = bytearray((folder / "d.zip").read_bytes())
    data[data.index(b'"h"') + 1] = ord("z")  # its checksum no longer holds
    (folder / "d.zip").write_bytes(bytes(data))
    zipped(folder / "e.zip", [("n.log", "only noise\n"), ("blank.json", " \n"), ("deep.json", json.dumps([[[[[[[{"role": "user", "content": "far"}]]]]]]]))])
    heads, _, told = run("")
    assert set(heads) == {"g"}
    assert told == [("bad.zip", None, "no zip archive"), ("d.zip", "b.json", "damaged"), ("e.zip", "deep.json", "nested too deeply"), ("e.zip", "n.log", "no JSON")]


def test_large_members_are_reported_and_not_read(spark, load):
    folder, run = load
    zipped(folder / "l.zip", [("big.json", " " * (archives.MAX_MEMBER + 1)), ("small.json", json.dumps({"id": "s", "messages": [{"role": "user", "content": "ok"}]}))])
    heads, _, told = run()
    assert set(heads) == {"s"} and told == [("l.zip", "big.json", "too large")]
    assert archives.files(spark, str(folder)).inputFiles() and "content" not in archives.files(spark, str(folder))._jdf.queryExecution().executedPlan().toString()


def test_an_id_of_two_sessions_stays_with_the_first(load):
    folder, run = load
    one = lambda t: {"id": "same", "messages": [{"role": "user", "content": t}]}
    zipped(folder / "p" / "a.zip", [("a.json", json.dumps([one("first"), one("second")])), ("b.json", json.dumps(one("third")))])
    zipped(folder / "q" / "a.zip", [("a.json", json.dumps(one("elsewhere")))])
    heads, said, _ = run()
    texts = sorted((m.project, m.text, k == "same") for k, v in said.items() for m in v)
    assert texts == [("p", "first", True), ("p", "second", False), ("p", "third", False), ("q", "elsewhere", True)]
    assert len(heads) == 3  # "same" is an id in both projects


def test_an_empty_folder_gives_empty_tables(load):
    folder, run = load
    assert run() == ({}, {}, [])


def test_nulls_ties_and_odd_values(load):
    folder, run = load
    odd = {"id": True, "messages": [None, 3, {"role": None, "type": "user", "content": None, "text": "t"}, {"role": "user", "content": ""}, {"role": "user", "content": {"text": ["a", {"value": "b"}]}, "usage": {"input_tokens": True, "output_tokens": 2.0}}]}
    zipped(folder / "o.zip", [("o.json", json.dumps(odd)), ("o.json.jsonl", 'null\n5\n"x"\n[]\n{}\n')])
    heads, said, told = run()
    (key,) = heads
    assert [m.text for m in said[key]] == ["t", "a\n\nb"] and (heads[key].input_tokens, heads[key].output_tokens) == (0, 2) and told == []


def test_written_archives_come_back(spark, load):
    folder, run = load
    rows = [(f"a{i % 3}", f"m{i}.json", json.dumps({"id": f"s{i}", "messages": [{"role": "user", "content": f"é{i}"}]})) for i in range(20)]
    df = spark.createDataFrame(rows, "archive string, member string, text string")
    assert archives.write_archives(df, f"file://{folder}") == archives.write_archives(df, f"file://{folder}") == 3
    heads, said, told = run()
    assert {k: v[0].text for k, v in said.items()} == {f"s{i}": f"é{i}" for i in range(20)} and told == [] and len(heads) == 20


def test_json_values_end_with_their_text(spark):
    from pyspark.sql import functions as F

    from tracelake.functions.variant import canonical

    cases = {'{"b": 1.0, "a": []}': '{"a":[],"b":1}', ' "x" ': '"x"', "null": "null", '{"a": 1}\n{"a": 2}': None, "1, 2": None, "[1] tail": None, "1],[2": None, "1] x": None, "": None, " ": None, None: None}
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, v string").orderBy("i").select(canonical(F.col("v")))
    assert [r[0] for r in rows.collect()] == list(cases.values())


def test_values_tell_their_kind_without_a_walk(spark):
    from pyspark.sql import functions as F

    from tracelake.functions.variant import items_at, json_value

    texts = ['{"a": [1, null], "_": 2}', "{}", "[]", "[[1]]", '"s"', "1", "null", "x", None]
    v = json_value(F.col("t"))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", archives.is_object(v).alias("o"), F.size(items_at(v, "$")).alias("n"), F.size(items_at(v, "$.a")).alias("a"))
    assert {r["t"]: (bool(r["o"]), r["n"], r["a"]) for r in df.collect()} == {
        texts[0]: (True, None, 2), "{}": (True, None, None), "[]": (False, 0, None), "[[1]]": (False, 1, None), '"s"': (False, None, None),
        "1": (False, None, None), "null": (False, None, None), "x": (False, None, None), None: (False, None, None),
    }
    assert "schemaOfVariant" not in df._jdf.queryExecution().optimizedPlan().toString()
