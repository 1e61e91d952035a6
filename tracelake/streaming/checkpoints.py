"""Bounded checkpoints of growing traces: a closed segment never changes.

A segment closes after the first assistant message at or beyond any limit
that a user message follows. The counters start anew with each segment, so a
session's messages are walked in order; what the walk knows of the open
segment is a few numbers. In a batch, messages are sorted within partitions
and streamed; in a stream, the numbers are each session's state. Either way a
message's segment is settled when it arrives, so that any split into batches
gives the same segments.

messages: ``session``, ``place`` (ascends within a session, as byte offsets
do), ``role``, ``text_bytes``, ``raw_start``, ``raw_end`` (byte range in the
source). Texts themselves are not needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SEGMENTS = "session string, segment int, segment_id string, first long, last long, messages int, users int, text_bytes long, raw_start long, raw_end long, sealed boolean"
STATE = "segment int, first long, last long, messages int, users int, text_bytes long, raw_start long, raw_end long, closable boolean"
SEGMENT = Row(*(c.split()[0] for c in SEGMENTS.split(", ")))
COLUMNS = ("session", "place", "role", "text_bytes", "raw_start", "raw_end")


@dataclass(frozen=True)
class Limits:
    messages: int = 40
    users: int = 20
    text_bytes: int = 4 << 20
    raw_bytes: int = 8 << 20


@dataclass
class Open:
    """The open segment of a session."""

    segment: int = 0
    first: int = 0
    last: int = -1
    messages: int = 0
    users: int = 0
    text_bytes: int = 0
    raw_start: int = 0
    raw_end: int = 0
    closable: bool = False

    def row(self, session: str, sealed: bool, raw_end: int | None = None) -> tuple:
        name = session if self.segment == 0 else f"{session}_seg-{self.segment:04d}"
        raw = (self.raw_start, raw_end) if sealed else (None, None)
        return (session, self.segment, name, self.first, self.last, self.messages, self.users, self.text_bytes, *raw, sealed)

    def add(self, session: str, place: int, role: str, text_bytes: int, raw_start: int, raw_end: int, limits: Limits) -> tuple | None:
        """Takes a message; the row of the segment that it closed, if it did."""
        closed = None
        if self.closable and role == "user":
            closed = self.row(session, True, raw_start)
            self.segment, self.first, self.messages, self.users, self.text_bytes, self.raw_start = self.segment + 1, place, 0, 0, 0, raw_start
        elif self.messages == 0:
            self.first = place
        self.last, self.raw_end = place, raw_end
        self.messages, self.users, self.text_bytes = self.messages + 1, self.users + (role == "user"), self.text_bytes + text_bytes
        over = self.messages >= limits.messages or self.users >= limits.users or self.text_bytes >= limits.text_bytes or raw_end - self.raw_start >= limits.raw_bytes
        self.closable = role == "assistant" and over
        return closed


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENTS.split(", ")])
    return frame.astype({"raw_start": "Int64", "raw_end": "Int64"})


def _slim(messages: DataFrame) -> DataFrame:
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return messages.select(F.col("session").cast("string").alias("session"), F.col("place").cast("long").alias("place"), F.coalesce("role", F.lit("")).alias("role"), *map(number, COLUMNS[3:]))


def _walked(frames: Iterator[pd.DataFrame], limits: Limits) -> Iterator[pd.DataFrame]:
    """Segments of sessions whose messages come one after the other, in order."""
    now, state = None, Open()
    for pdf in frames:
        rows = []
        for session, place, *message in zip(*(pdf[c].tolist() for c in COLUMNS), strict=True):
            if session != now:
                if now is not None:
                    rows.append(state.row(now, False))
                now, state = session, Open()
            if place > state.last:
                closed = state.add(session, place, *message, limits)
                rows += [closed] if closed else []
        yield _frame(rows)
    if now is not None:
        yield _frame([state.row(now, False)])


def segments(messages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All segments of all sessions; the last of each is open. A repeated place counts once."""
    rows = _slim(messages).where("session IS NOT NULL AND place >= 0")
    ordered = rows.repartition("session").sortWithinPartitions("session", "place")
    return ordered.mapInPandas(lambda frames: _walked(frames, limits), SEGMENTS)


class Checkpointer(StatefulProcessor):
    """Keeps each session's open segment; gives what a batch closed, and the open one as it stands.

    Takes rows: sessions have few in a batch, and a data frame for each costs more than they do.
    """

    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.open.get()
        state = Open(*known) if known else Open()
        out = []
        for place, *message in sorted([tuple(r[c] for c in COLUMNS[1:]) for r in rows], key=lambda m: m[0]):  # one session's rows of one batch, without texts
            if place > state.last:  # else the message was there before
                closed = state.add(key[0], place, *message, self.limits)
                out += [closed] if closed else []
        self.open.update((state.segment, state.first, state.last, state.messages, state.users, state.text_bytes, state.raw_start, state.raw_end, state.closable))
        for row in [*out, state.row(key[0], False)]:
            yield SEGMENT(*row)

    def close(self) -> None:
        pass


def stream_segments(messages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """As segments(), over a stream: rows of closed segments once, of open ones whenever they grew.

    A session's messages must come in the order of their places, as lines of
    one file do; what comes again is passed over. Sinks keep ``current()``.
    """
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _slim(messages).where("session IS NOT NULL AND place >= 0")
    return rows.groupBy("session").transformWithState(Checkpointer(limits), SEGMENTS, "Update", "None")


def current(rows: DataFrame) -> DataFrame:
    """The newest row of each segment out of those that a stream gave."""
    columns = [c for c in rows.columns if c not in ("session", "segment")]
    newest = rows.groupBy("session", "segment").agg(F.max_by(F.struct(*columns), F.struct("sealed", "last")).alias("s"))
    return newest.select("session", "segment", "s.*")
