"""Growing traces: any split into batches gives the segments of one batch, and closed ones stay."""

import random

import pytest
from pyspark.sql import Row

from tracelake.streaming.checkpoints import COLUMNS, Checkpointer, Limits, current, segments, stream_segments

SCHEMA = "session string, place long, role string, text_bytes long, raw_start long, raw_end long, text string"
LIMITS = Limits(messages=6, users=4, text_bytes=300, raw_bytes=2000)


def made(seed):
    rng = random.Random(seed)
    rows = []
    for s in "abcde":
        raw = 0
        for _ in range({"a": 120, "e": 1}.get(s, 40)):
            size = rng.choice([10, 50, 100, 900])
            rows.append((s, raw, rng.choice(["user", "user", "assistant", "assistant", "tool", None]), rng.randrange(0, 120), raw, raw + size, "t"))
            raw += size + rng.randrange(3)
    return rows


def plain(rows, limits):
    """By the rule: boundaries first, then the segments between them."""
    out = []
    for s in sorted({r[0] for r in rows}):
        own = sorted({r for r in rows if r[0] == s}, key=lambda r: r[1])
        cuts, start, raw = [0], 0, 0
        for i, m in enumerate(own[:-1]):
            part = own[start : i + 1]
            over = len(part) >= limits.messages or sum(r[2] == "user" for r in part) >= limits.users or sum(r[3] for r in part) >= limits.text_bytes or m[5] - raw >= limits.raw_bytes
            if over and m[2] == "assistant" and own[i + 1][2] == "user":
                start, raw = i + 1, own[i + 1][4]
                cuts.append(start)
        for n, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(own)], strict=True)):
            sealed = b < len(own)
            part = own[a:b]
            raw_range = (0 if a == 0 else part[0][4], own[b][4]) if sealed else (None, None)
            name = s if n == 0 else f"{s}_seg-{n:04d}"
            out.append((s, n, name, part[0][1], part[-1][1], len(part), sum(r[2] == "user" for r in part), sum(r[3] for r in part), *raw_range, sealed))
    return out


@pytest.mark.parametrize("limits", [LIMITS, Limits(), Limits(10**6, 10**6, 10**9, 700)])
def test_batch_equals_the_rule(spark, limits):
    rows = made(1)
    df = spark.createDataFrame(rows + rows[5:9] + [(None, 1, "user", 1, 1, 1, "t")], SCHEMA).repartition(3)
    assert sorted(map(tuple, segments(df, limits).collect())) == plain(rows, limits)


def test_empty(spark):
    assert segments(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_in_any_batches(spark, tmp_path):
    """Three runs of the query with one checkpoint, one of them fed old messages again; closed rows never change."""
    rows = made(2)
    feed, check, out = (f"{tmp_path}/{n}" for n in ("in", "check", "out"))
    seen = {}
    cuts = [0, 35, 36, len(rows)]
    by_session = {s: [r for r in rows if r[0] == s] for s in "abcde"}
    for n in range(3):
        new = [r for own in by_session.values() for r in own[cuts[n] * len(own) // len(rows) : cuts[n + 1] * len(own) // len(rows)]]
        old = rows[:4] if n else []
        spark.createDataFrame(new + old, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        stream = stream_segments(spark.readStream.schema(SCHEMA).parquet(feed), LIMITS).writeStream.outputMode("update")
        stream.foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        now = {r[:2]: r for r in map(tuple, current(spark.read.parquet(out)).collect())}
        assert all(now[k] == v for k, v in seen.items())
        seen = {k: v for k, v in now.items() if v[-1]}
    assert sorted(now.values()) == plain(rows, LIMITS)
    assert COLUMNS[0] == "session"


def test_a_session_of_a_batch_takes_two_calls_of_its_state():
    calls = []

    class Value:
        def get(self):
            calls.append("get")

        def update(self, value):
            calls.append(value)

    own = Checkpointer(LIMITS)
    own.open = Value()
    rows = [Row(session="a", place=p, role="user", text_bytes=1, raw_start=p, raw_end=p + 1) for p in (3, 1)]
    assert list(map(tuple, own.handleInputRows(("a",), iter(rows), None))) == [("a", 0, "a", 1, 3, 2, 2, 2, None, None, False)]
    assert calls == ["get", (0, 1, 3, 2, 2, 2, 0, 4, False)]
