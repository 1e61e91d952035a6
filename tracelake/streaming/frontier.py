"""Consumers with two high-water marks: new events and new overrides touch sessions, which are recomputed.

A consumer's folder::

    results/version=V/bucket=B   results of all sessions of a bucket, as of version V
    commits/V                    one row: the marks after V, the buckets that V wrote

An advance takes a snapshot of both tables (their largest ids), finds the
sessions of events and overrides beyond the marks, recomputes these from all
their rows up to the snapshot, and writes the buckets that they are in, with
what the other sessions of those buckets had. The commit is written last: a
failed advance leaves files that nobody reads, and the next one does the same
work. Late overrides of old events thus recompute their session and no other;
a consumer that starts anew gets the same results.

Tables written by ``append`` are partitioned by the same buckets, so that an
advance reads the touched buckets only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.sources.store import exists

#: Buckets of sessions; a bucket is what an advance rewrites at least.
BUCKETS = 64
COMMIT = "version long, event_id long, write_seq long, buckets array<int>, sessions long, events long, overrides long"


def bucket() -> Column:
    return F.pmod(F.xxhash64(F.col("session").cast("string")), F.lit(BUCKETS)).cast("int")


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a table that is partitioned by the bucket of their session."""
    rows.withColumn("bucket", bucket()).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)


@dataclass(frozen=True)
class Advance:
    """What an advance did."""

    version: int
    sessions: int
    events: int
    overrides: int
    buckets: tuple[int, ...] = ()


class Consumer:
    """Keeps ``compute(events, overrides)`` up to date by session.

    compute gives rows with a ``session`` that depend on that session's events
    (``session``, ``event_id``, ..) and overrides (``session``, ``write_seq``,
    ..) alone. Without overrides there is one mark.
    """

    def __init__(self, spark: SparkSession, folder: str, compute: Callable[[DataFrame, DataFrame | None], DataFrame], schema: str) -> None:
        self.spark, self.folder, self.compute, self.schema = spark, folder, compute, schema

    def _commits(self) -> DataFrame:
        if not exists(self.spark, f"{self.folder}/commits"):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits")

    def state(self) -> tuple[int, int, int]:
        """(version, event mark, override mark) of the last commit; -1 and zeros before the first."""
        last = self._commits().orderBy(F.col("version").desc()).first()
        return (last["version"], last["event_id"], last["write_seq"]) if last else (-1, 0, 0)

    def results(self, buckets: list[int] | None = None) -> DataFrame:
        """The current rows: those of each bucket's newest committed version."""
        newest = self._commits().select("version", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.max("version").alias("version"))
        if buckets is not None:
            newest = newest.where(F.col("bucket").isin(buckets))
        paths = [p for r in newest.collect() if exists(self.spark, p := f"{self.folder}/results/version={r['version']}/bucket={r['bucket']}")]  # BUCKETS at most
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def advance(self, events: DataFrame, overrides: DataFrame | None = None, rebuild: bool = False, only: DataFrame | None = None) -> Advance:
        """Brings the results up to the tables' present rows.

        rebuild: all sessions from nothing; only: these sessions (a ``session``
        column) besides, without moving the marks for others.
        """
        version, event_mark, override_mark = self.state()
        top = lambda df, c: df.agg(F.coalesce(F.max(c), F.lit(0))).first()[0] if df is not None else 0
        event_top, override_top = top(events, "event_id"), top(overrides, "write_seq")
        if rebuild:
            event_mark = override_mark = 0
        snapshot = events.where(F.col("event_id") <= event_top)
        corrections = overrides.where(F.col("write_seq") <= override_top) if overrides is not None else None
        tables = [(snapshot, "event_id", event_mark)] + ([(corrections, "write_seq", override_mark)] if overrides is not None else [])
        fresh = [df.where(F.lit(True) if rebuild else F.col(c) > mark).groupBy("session").agg(F.count(F.lit(1)).alias(c)) for df, c, mark in tables]
        touched = reduce(lambda a, b: a.join(b, "session", "full_outer"), fresh)
        if only is not None:
            touched = touched.join(only.select("session").distinct(), "session", "full_outer")
        counts = {"event_id": F.col("event_id"), "write_seq": F.col("write_seq") if overrides is not None else F.lit(None)}
        path = f"{self.folder}/touched/version={version + 1}"
        touched.select("session", bucket().alias("bucket"), *(F.coalesce(v, F.lit(0)).alias(k) for k, v in counts.items())).write.mode("overwrite").parquet(path)
        touched = self.spark.read.parquet(path)
        found = touched.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("e"), F.sum("write_seq").alias("o")).collect()  # BUCKETS at most
        if not found and not rebuild:
            return Advance(version, 0, 0, 0)
        buckets = list(range(BUCKETS)) if rebuild else [r["bucket"] for r in found]

        def of_touched(df: DataFrame | None) -> DataFrame | None:
            if df is None:
                return None
            pruned = df.where(F.col("bucket").isin(buckets)).drop("bucket") if "bucket" in df.columns else df
            return pruned.join(touched.select("session"), "session", "left_semi")

        new = self.compute(of_touched(snapshot), of_touched(corrections))
        kept = self.results(buckets).join(touched.select("session"), "session", "left_anti")
        columns = self.spark.createDataFrame([], self.schema).columns
        rows = new.select(*columns) if rebuild else new.select(*columns).unionByName(kept)
        rows.withColumn("bucket", bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/results/version={version + 1}")
        done = Advance(version + 1, *(sum(r[c] for r in found) for c in ("n", "e", "o")), tuple(sorted(buckets)))
        marks = (event_top, override_top)
        commit = self.spark.createDataFrame([(done.version, *marks, list(done.buckets), done.sessions, done.events, done.overrides)], COMMIT)
        commit.coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return done
