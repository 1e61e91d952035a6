"""Bundles of sessions: export with digests, and import into a store whose ids are others.

A store has the tables

    sessions    id, session_key, and what else describes them
    events      id, session_id, source, source_path, source_offset, seq, ..
    overrides   session_id, event_key, ..
    usage       event_id, session_id, ..
    incidents   id, session_id, first_event_id, last_event_id, ..

A bundle is JSON lines, one record each: ``session_key``, ``kind``, ``body``
(canonical JSON). No body has an id: a session is named by its key, an event
by the four parts of its origin, so that a bundle means the same in any store.
The manifest has a line for each session: version, records, and a digest over
its records in two levels (by the first byte of a record's hash, then over
these), so that no session's records are gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.variant import canonical

VERSION = 1
ORIGIN = ("source", "source_path", "source_offset", "seq")
#: Columns of each kind that point to events.
POINTERS = {"events": (), "overrides": (), "usage": ("event_id",), "incidents": ("first_event_id", "last_event_id")}
#: Columns that only a store knows.
LOCAL = ("id", "session_id")
Store = dict[str, DataFrame]
Write = Callable[[DataFrame, str], DataFrame]


def origin(prefix: str = "") -> Column:
    return F.to_json(F.array(*(F.col(prefix + c).cast("string") for c in ORIGIN)))


def records(store: Store) -> DataFrame:
    """session_key, kind, body of everything in a store."""
    keys = store["sessions"].select(F.col("id").alias("session_id"), "session_key")
    events = store["events"].select(F.col("id").alias("_id"), origin().alias("_origin"))
    described = [c for c in store["sessions"].columns if c not in ("id", "session_key")]
    out = [store["sessions"].select("session_key", F.lit("session").alias("kind"), (F.to_json(F.struct(*described)) if described else F.lit("{}")).alias("body"))]
    for kind, pointers in POINTERS.items():
        rows = store[kind].join(keys, "session_id")
        for c in pointers:
            named = events.select(F.col("_id").alias(c), F.col("_origin").alias(f"{c}_origin"))
            rows = rows.join(named, c, "left").drop(c)
        columns = [c for c in rows.columns if c not in (*LOCAL, "session_key")]
        out.append(rows.select("session_key", F.lit(kind).alias("kind"), F.to_json(F.struct(*columns)).alias("body")))
    return reduce(DataFrame.unionByName, out).withColumn("body", canonical(F.col("body")))


def manifest(lines: DataFrame) -> DataFrame:
    """session_key, version, n, digest of each session's records, whatever their order."""
    hashed = lines.select("session_key", F.sha2(F.concat_ws("\n", "session_key", "kind", "body"), 256).alias("h"))
    parts = hashed.groupBy("session_key", F.substring("h", 1, 2).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: F.concat(x["part"], x["d"])), ""), 256)
    return parts.groupBy("session_key").agg(F.lit(VERSION).alias("version"), F.sum("n").alias("n"), whole.alias("digest"))


def export(store: Store, folder: str) -> None:
    """Writes the records and the manifest of a store below a new folder."""
    spark = store["sessions"].sparkSession
    records(store).write.json(f"{folder}/records")
    manifest(read_records(spark, folder)).write.json(f"{folder}/manifest")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("session_key string, kind string, body string").json(f"{folder}/records")


def promised(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest that came with the records."""
    return spark.read.schema("session_key string, version int, n long, digest string").json(f"{folder}/manifest")


def verified(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records of sessions whose digest and version hold, the other sessions: session_key, problem)."""
    lines = read_records(spark, folder)
    found = manifest(lines).select("session_key", F.col("n").alias("_n"), F.col("digest").alias("_digest"))
    both = promised(spark, folder).join(found, "session_key", "full_outer")
    problem = (
        F.when(F.col("version").isNull(), "not in the manifest").when(F.col("version") != VERSION, "another version").when(F.col("_n").isNull(), "no records")
        .when(F.col("n") != F.col("_n"), "records are missing or too many").when(F.col("digest") != F.col("_digest"), "records were changed")
    )
    judged = both.select("session_key", problem.alias("problem"))
    return lines.join(judged.where("problem IS NULL").select("session_key"), "session_key", "left_semi"), judged.where("problem IS NOT NULL")


def _numbered(rows: DataFrame, taken: DataFrame, write: Write, name: str) -> DataFrame:
    """New rows with ids beyond those that are taken; written once, so that an id stays."""
    top = taken.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    return write(rows.crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + 1 + F.monotonically_increasing_id()).drop("_top"), name)


def imported(lines: DataFrame, store: Store, write: Write) -> Store:
    """The store with a bundle's records: sessions and events that it has stay, references become its own ids.

    Events are known by their origin, incidents and overrides by all that they
    say; importing a bundle twice adds nothing.
    """
    out = dict(store)
    lines = write(lines, "bundle")

    def of(kind: str, more: str = "") -> DataFrame:
        fields = [f for f in store["sessions" if kind == "session" else kind].schema.fields if f.name not in (*LOCAL, "session_key", *POINTERS.get(kind, ()))]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *([more] if more else [])])
        return lines.where(F.col("kind") == kind).select("session_key", F.from_json("body", schema).alias("j")).select("session_key", "j.*")

    new = of("session").join(store["sessions"].select("session_key"), "session_key", "left_anti")
    out["sessions"] = write(store["sessions"].unionByName(_numbered(new, store["sessions"], write, "new-sessions").select(*store["sessions"].columns)), "sessions")
    local = out["sessions"].select(F.col("id").alias("session_id"), "session_key")

    known = store["events"].select(*ORIGIN)
    same = reduce(lambda a, b: a & b, (F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ORIGIN))
    new = of("events").dropDuplicates([*ORIGIN]).alias("n").join(known.alias("k"), same, "left_anti").join(local, "session_key")
    out["events"] = write(store["events"].unionByName(_numbered(new, store["events"], write, "new-events").select(*store["events"].columns)), "events")
    ids = out["events"].select(F.col("id").alias("_id"), origin().alias("_origin"))
    for kind in ("overrides", "usage", "incidents"):
        pointers = POINTERS[kind]
        rows = of(kind, ", ".join(f"{c}_origin string" for c in pointers)).join(local, "session_key")
        for c in pointers:
            rows = rows.join(ids.select(F.col("_id").alias(c), F.col("_origin").alias(f"{c}_origin")), f"{c}_origin", "left").drop(f"{c}_origin")
        columns = [c for c in store[kind].columns if c != "id"]
        match = reduce(lambda a, b: a & b, (F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in columns))
        new = rows.select(*columns).distinct().alias("n").join(store[kind].select(*columns).alias("k"), match, "left_anti")
        new = _numbered(new, store[kind], write, f"new-{kind}") if "id" in store[kind].columns else new
        out[kind] = write(store[kind].unionByName(new.select(*store[kind].columns)), kind)
    return out
