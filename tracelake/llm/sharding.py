"""Sharding: minimax contiguous partition of ordered atomic groups.

Documents with equal texts form one atomic group. Groups larger than the fair
share of what is left come first in the order, a shard each; the others are
ordered by the hash of their text. The smallest capacity for which these fit
into the other shards, contiguously, is found by binary search, each candidate
checked greedily, and the order is cut where the greedy check at that capacity
cuts it. Only DataFrame functions run.

The check needs prefix sums of group sizes, not the groups: the driver holds
sums over 2**BITS ranges of the hash and, for ranges in which a cut of the
search can lie, sums over ever finer ranges, until the cut lies between two
groups. A refinement splits at most SPLIT ranges for each shard, so it brings
at most SPLIT * shards * 2**BITS rows to the driver, whatever the corpus.

Defined results: a null text counts as an empty one and has size 1; texts
whose 64-bit hashes collide form one group; groups of equal size are told
apart by their hash, slots of a shard by a hash of the row and then by doc_id
(null first), text_crc32 and size, and rows equal in these may swap slots; a
null doc_id is placed like any other; an empty table has no rows; repeated
rows each take a slot; further columns are left out; a very long text is never
cut, so the shard that has it may be larger than the others.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import rank_in_groups, written

#: Each refinement splits a hash range into 2**BITS parts; ranges that it splits for each shard.
BITS, SPLIT = 10, 16
#: Capacities between the bounds that a round of the search looks at.
PROBES = 8


def sized(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32 and the group's hash."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("group_hash"),
    )


def giants(groups: DataFrame, shards: int) -> list[int]:
    """Hashes of the groups larger than the fair share of what is left: fewer than ``shards``."""
    total, found = groups.agg(F.sum("bytes")).first()[0] or 0, {}
    while True:
        share = (total - sum(found.values())) / (shards - len(found))
        more = {r["group_hash"]: r["bytes"] for r in groups.where(F.col("bytes") > share).collect()}
        if more.keys() <= found.keys():
            return sorted(found)
        found |= more


class Ranges:
    """Ordered hash ranges with their sizes, refined where a cut may fall."""

    def __init__(self, groups: DataFrame) -> None:
        self.groups = groups  # group_hash, bytes
        self.most = 0  # rows that came to the driver at once
        self.parts = self._summed(groups, 64 - BITS)
        self._index()

    def _summed(self, groups: DataFrame, shift: int) -> list[dict]:
        """Sizes by the hash's upper bits; the number of rows is bounded by the ranges asked for."""
        rows = groups.groupBy(F.shiftright("group_hash", shift).alias("part")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("group_hash").alias("low")
        )
        parts = [r.asDict() | {"shift": shift} for r in rows.collect()]
        self.most = max(self.most, len(parts))
        return parts

    def _index(self) -> None:
        self.parts.sort(key=lambda p: p["low"])
        self.ends, total = [], 0
        for p in self.parts:
            total += p["bytes"]
            self.ends.append(total)
        self.total = total

    def floor(self, x: int, hopeful: bool = False) -> int:
        """The largest boundary between groups that is at most x.

        Where x falls into an unresolved range: its start, or x if hopeful.
        """
        if x >= self.total:
            return self.total
        j = bisect_right(self.ends, x)
        start = self.ends[j - 1] if j else 0
        return x if hopeful and self.parts[j]["n"] > 1 else start

    def unresolved(self, low: int, high: int) -> list[int]:
        """Numbers of the ranges between two positions that hold several groups."""
        first, last = bisect_right(self.ends, low), min(bisect_right(self.ends, high), len(self.parts) - 1)
        return [j for j in range(first, last + 1) if self.parts[j]["n"] > 1]

    def refine(self, numbers: list[int]) -> None:
        """Splits these ranges into finer ones, one job for each width among them."""
        chosen = [self.parts[j] for j in numbers]
        gone = {p["low"] for p in chosen}
        self.parts = [p for p in self.parts if p["low"] not in gone]
        for shift in {p["shift"] for p in chosen}:
            upper = F.shiftright("group_hash", shift)
            own = self.groups.where(upper.isin([p["part"] for p in chosen if p["shift"] == shift]))
            self.parts += self._summed(own, max(0, shift - BITS))
        self._index()

    def walk(self, capacity: int, shards: int, hopeful: bool = False) -> list[int]:
        """Greedy check: where each shard ends if it takes all that fits."""
        out, at = [], 0
        for _ in range(shards):
            at = self.floor(at + capacity, hopeful)
            out.append(at)
        return out

    def smallest(self, low: int, shards: int, hopeful: bool) -> int:
        """Binary search for the smallest capacity that passes the check."""
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards, hopeful)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def open_at(self, capacity: int, shards: int) -> set[int]:
        """Unresolved ranges in which a shard of this capacity may end."""
        ends = [e for hopeful in (False, True) for e in [0, *self.walk(capacity, shards, hopeful)[:-1]]]
        return {j for e in ends for j in self.unresolved(e + capacity, e + capacity)}

    def exact_floor(self, x: int) -> int:
        while x < self.total and (j := self.unresolved(x, x)) and self.floor(x) != x:
            self.refine(j)
        return self.floor(x)


def search(groups: DataFrame, shards: int) -> tuple[int, list[int], Ranges]:
    """(smallest capacity, for each shard but the last the first hash beyond it, what the search has read).

    ``groups`` (group_hash, bytes) is read once for each refinement. Two checks
    bound the capacity: one that hopes for a boundary wherever a range is not
    resolved, one that expects none. Where they meet, it is exact.
    """
    ranges = Ranges(groups)
    if not ranges.total:
        return 0, [], ranges
    least = max(groups.agg(F.max("bytes")).first()[0], -(-ranges.total // shards))
    while True:
        low, high = ranges.smallest(least, shards, True), ranges.smallest(least, shards, False)
        if low == high:
            break
        # All ranges that the cuts can lie in, if few; else those of some capacities between the bounds.
        spans = zip(ranges.walk(low, shards), ranges.walk(high, shards, True), strict=True)
        open_ = {j for first, last in spans for j in ranges.unresolved(first, last)} | ranges.open_at(low, shards)
        if len(open_) > SPLIT * shards:
            open_ = set().union(*(ranges.open_at(low + (high - low) * i // PROBES, shards) for i in range(PROBES)))
        ranges.refine(sorted(open_))
    at, cuts = 0, []
    for _ in range(shards - 1):
        at = ranges.exact_floor(at + high)
        j = bisect_right(ranges.ends, at)
        if j < len(ranges.parts):
            cuts.append(ranges.parts[j]["low"])
    return high, cuts, ranges


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(smallest capacity, for each shard but the last the first hash beyond it)."""
    return search(groups, shards)[:2]


def with_shard(docs: DataFrame, cuts: list[int], alone: list[int] = ()) -> DataFrame:
    """Adds ``shard``: that of a group of its own, else how many cuts the hash has reached. No shuffle."""
    number = reduce(lambda a, b: a + b, ((F.col("group_hash") >= c).cast("int") for c in cuts), F.lit(len(alone)))
    for i, h in enumerate(alone):
        number = F.when(F.col("group_hash") == h, i).otherwise(number)
    return docs.withColumn("shard", number)


def cut(groups: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """(cuts, groups with a shard of their own), as with_shard() takes them."""
    alone = giants(groups, shards)
    _, cuts = minimax_cuts(groups.where(~F.col("group_hash").isin(alone)) if alone else groups, shards - len(alone))
    return cuts, alone


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, group_hash, shard, slot (gapless in the shard)."""
    slim = written(spark, sized(docs, text, doc_id), "shard-sizes")
    groups = written(spark, slim.groupBy("group_hash").agg(F.sum("size").alias("bytes")), "shard-groups")
    placed = with_shard(slim, *cut(groups, shards))
    order = F.xxhash64("doc_id", "text_crc32", "size")
    return rank_in_groups(placed, ["shard"], order, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")


def write_shards(docs: DataFrame, cuts: list[int], path: str, text: str = "text", alone: list[int] = ()) -> None:
    """The documents themselves, every column, in one folder per shard; no shuffle."""
    body = F.coalesce(F.col(text), F.lit(""))
    taken = with_shard(docs.withColumn("group_hash", F.xxhash64(body)), cuts, alone)
    taken.drop("group_hash").write.partitionBy("shard").parquet(path)
