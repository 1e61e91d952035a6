"""Bundles: export, import into a store with other ids, export again; damaged and repeated bundles."""

import glob
import random
import uuid

import pytest

from tracelake.sources import bundles

SCHEMAS = {
    "sessions": "id long, session_key string, client string, started_at string", "events": "id long, session_id long, source string, source_path string, source_offset long, seq int, type string, raw_json string",
    "overrides": "session_id long, event_key string, type string, write_seq long", "usage": "event_id long, session_id long, model string, input long, cost double", "incidents": "id long, session_id long, first_event_id long, last_event_id long, kind string, count long",
}


def made(seed, sessions=12):
    rng = random.Random(seed)
    s = [(i * 3 + 1, f"claude:{i}", rng.choice(["claude", None]), "2026") for i in range(sessions)]
    e = [(i * 2 + 5, rng.choice(s)[0], rng.choice(["log", None]), f"p{i % 4}", i, i % 3, "x", '{"b": 1.50, "a": "é\\n"}') for i in range(150)]
    of = lambda: rng.choice(e)
    o = [(rng.choice(s)[0], f"k{i}", "y", i) for i in range(30)]
    u = [(*((x := of())[:2]), "m", i, 0.1 * i) for i in range(60)]
    n = [(i + 1, (x := of())[1], x[0], of()[0], "loop", i) for i in range(20)]
    return {"sessions": s, "events": e, "overrides": o, "usage": u, "incidents": n}


def store(spark, rows):
    return {k: spark.createDataFrame(rows.get(k, []), schema) for k, schema in SCHEMAS.items()}


@pytest.fixture
def write(spark, tmp_path):
    def put(df, name):
        path = f"{tmp_path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return put


def digests(s):
    return {r["session_key"]: (r["n"], r["digest"]) for r in bundles.manifest(bundles.records(s)).collect()}


def test_round_trip_through_other_ids(spark, tmp_path, write):
    first = store(spark, made(1))
    bundles.export(first, f"{tmp_path}/bundle")
    lines, problems = bundles.verified(spark, f"{tmp_path}/bundle")
    assert problems.count() == 0 and not any('"id"' in r["body"] or "session_id" in r["body"] for r in lines.collect())
    # A store that has one of the sessions, with some of its events, under other ids, and sessions of its own.
    key, origin_ = "claude:3", [e for e in made(1)["events"] if e[1] == 10][:2]
    own = {"sessions": [(700, key, None, "old"), (900, "own:1", "c", "2020")], "events": [(5000 + i, 700, *e[2:]) for i, e in enumerate(origin_)] + [(6000, 900, "own", "q", 1, 1, "z", "{}")]}
    second = bundles.imported(lines, store(spark, own), write)
    ids = {r["session_key"]: r["id"] for r in second["sessions"].collect()}
    assert ids[key] == 700 and len(set(ids.values())) == len(ids) == 13
    a, b = digests(first), digests(second)
    assert {k: v for k, v in b.items() if k not in (key, "own:1")} == {k: v for k, v in a.items() if k != key}
    assert b[key][0] == a[key][0]  # its description stays the store's
    again = bundles.imported(lines, second, write)
    assert {k: t.count() for k, t in again.items()} == {k: t.count() for k, t in second.items()}
    # Into an empty store, and out again: all the same.
    third = bundles.imported(lines, store(spark, {}), write)
    assert digests(third) == a
    assert {r["event_id"] for r in third["usage"].collect()} <= {r["id"] for r in third["events"].collect()}


def test_damaged_bundles(spark, tmp_path):
    bundles.export(store(spark, made(2, 4)), f"{tmp_path}/bundle")
    lines = bundles.read_records(spark, f"{tmp_path}/bundle").collect()
    changed = [r for r in lines if r["session_key"] != "claude:0"]
    changed = [(r["session_key"], r["kind"], r["body"].replace("loop", "hoop")) if r["session_key"] == "claude:1" else tuple(r) for r in changed]
    changed = [r for r in changed if r[0] != "claude:2" or r[1] != "overrides"] + [("claude:9", "session", "{}")]
    spark.createDataFrame(changed, "session_key string, kind string, body string").write.json(f"{tmp_path}/bad/records")
    spark.read.json(f"{tmp_path}/bundle/manifest").write.json(f"{tmp_path}/bad/manifest")
    good, problems = bundles.verified(spark, f"{tmp_path}/bad")
    assert {r["session_key"]: r["problem"] for r in problems.collect()} == {
        "claude:0": "no records", "claude:1": "records were changed", "claude:2": "records are missing or too many", "claude:9": "not in the manifest",
    }
    assert {r["session_key"] for r in good.collect()} == {"claude:3"}
    assert glob.glob(f"{tmp_path}/bad/manifest/*.json")


def test_the_manifest_that_came_is_that_of_the_records(spark, tmp_path):
    lines = spark.createDataFrame([("s", "session", "{}"), ("s", "events", '{"a":1}'), ("t", "session", "{}")], "session_key string, kind string, body string")
    lines.write.json(f"{tmp_path}/records")
    found = bundles.manifest(bundles.read_records(spark, str(tmp_path)))
    found.write.json(f"{tmp_path}/manifest")
    assert sorted(map(tuple, bundles.promised(spark, str(tmp_path)).collect())) == sorted(map(tuple, found.collect()))
