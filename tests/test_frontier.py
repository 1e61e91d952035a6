"""Consumers by two marks: increments equal a rebuild, late overrides recompute one session, failed advances leave no trace."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import canonical
from tracelake.streaming import frontier

EVENTS = "session long, event_id long, event_key string, event_at long, type string, confidence string"
OVERRIDES = "session long, event_key string, type string, confidence string, write_seq long"
RESULT = "session long, type string, n long"


def counted(events, overrides):
    return canonical.merged(events, overrides).groupBy("session", "type").agg(F.count(F.lit(1)).alias("n"))


def plain(spark, events, overrides):
    return sorted(map(tuple, counted(spark.createDataFrame(events, EVENTS), spark.createDataFrame(overrides, OVERRIDES)).collect()))


def made():
    rng = random.Random(6)
    events = [(rng.randrange(40), i, f"k{rng.randrange(6)}" if rng.random() < 0.8 else None, rng.randrange(100), rng.choice("abc"), rng.choice(["high", "low"])) for i in range(1, 300)]
    overrides = [(rng.randrange(45), f"k{rng.randrange(8)}", rng.choice("xyz"), rng.choice(["high", "medium"]), i) for i in range(1, 60)]
    return events, overrides


class Tables:
    """Stored tables that grow."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def add(self, events=(), overrides=()):
        for name, rows, schema in (("events", events, EVENTS), ("overrides", overrides, OVERRIDES)):
            frontier.append(self.spark.createDataFrame(list(rows), schema), f"{self.folder}/{name}")

    def read(self):
        return [self.spark.read.schema(f"{s}, bucket int").parquet(f"{self.folder}/{n}") for n, s in (("events", EVENTS), ("overrides", OVERRIDES))]


def test_increments_equal_a_rebuild(spark, tmp_path):
    events, overrides = made()
    tables = Tables(spark, f"{tmp_path}/t")
    consumer = frontier.Consumer(spark, f"{tmp_path}/c", counted, RESULT)
    got = lambda c=consumer: sorted(map(tuple, c.results().collect()))
    tables.add()
    assert consumer.advance(*tables.read()) == frontier.Advance(-1, 0, 0, 0) and got() == []
    tables.add(events[:150], overrides[:10])
    first = consumer.advance(*tables.read())
    assert (first.events, first.overrides) == (150, 10) and got() == plain(spark, events[:150], overrides[:10])
    assert consumer.advance(*tables.read()).sessions == 0
    tables.add(events[150:])
    consumer.advance(*tables.read())
    # An override of an old event: its session and bucket alone are written.
    late = (events[0][0], events[0][2] or "k1", "late", "high", 100)
    tables.add(overrides=[late])
    third = consumer.advance(*tables.read())
    assert (third.sessions, third.events, third.overrides, len(third.buckets)) == (1, 0, 1, 1)
    written = [d for d in os.listdir(f"{tmp_path}/c/results/version=2") if d.startswith("bucket=")]
    assert written == [f"bucket={third.buckets[0]}"]
    assert got() == plain(spark, events, [*overrides[:10], late])
    again = frontier.Consumer(spark, f"{tmp_path}/d", counted, RESULT)
    again.advance(*tables.read(), rebuild=True)
    assert got(again) == got() and again.state()[1:] == consumer.state()[1:] == (299, 100)
    # Rebuilt in place, and some sessions again: nothing changes.
    consumer.advance(*tables.read(), rebuild=True)
    assert consumer.advance(*tables.read(), only=spark.createDataFrame([(3,), (4,)], "session long")).sessions == 2
    assert got() == got(again)


def test_a_failed_advance_is_done_again(spark, tmp_path):
    events, overrides = made()
    tables = Tables(spark, f"{tmp_path}/t")
    tables.add(events, overrides)

    def broken(e, o):
        return counted(e, o).withColumn("n", F.raise_error(F.lit("broken")).cast("long"))

    with pytest.raises(Exception, match="broken"):
        frontier.Consumer(spark, f"{tmp_path}/c", broken, RESULT).advance(*tables.read())
    consumer = frontier.Consumer(spark, f"{tmp_path}/c", counted, RESULT)
    assert consumer.state() == (-1, 0, 0) and consumer.results().count() == 0
    consumer.advance(*tables.read())
    assert sorted(map(tuple, consumer.results().collect())) == plain(spark, events, overrides)


def test_one_mark_and_pruned_buckets(spark, tmp_path):
    events, _ = made()
    tables = Tables(spark, f"{tmp_path}/t")
    tables.add(events[:200])
    seen = []

    def counts(e, o):
        assert o is None
        seen.append(e._jdf.queryExecution().toString())
        return e.groupBy("session", "type").agg(F.count(F.lit(1)).alias("n"))

    consumer = frontier.Consumer(spark, f"{tmp_path}/c", counts, RESULT)
    consumer.advance(tables.read()[0])
    tables.add([(7, 1000, "k", 1, "a", "high")])
    assert consumer.advance(tables.read()[0]).buckets == (spark.createDataFrame([(7,)], "session long").select(frontier.bucket()).first()[0],)
    assert "PartitionFilters: [isnotnull(bucket" in seen[-1]
    rows = [*events[:200], (7, 1000, "k", 1, "a", "high")]
    want = sorted(map(tuple, spark.createDataFrame(rows, EVENTS).groupBy("session", "type").count().collect()))
    assert sorted(map(tuple, consumer.results().collect())) == want
