"""Trie of conversations by shared first turns, over vertical bitmaps.

Conversations are sorted by id and cut into shards of a bounded number of
turns. A shard indexes (position, turn) to the bitset of its conversations
that have this turn there, and (length) to the bitset of those that end
there. A depth-first descent intersects a node's bitset with the posting of
the next turn of its lowest conversation, takes that child out of the bitset
and goes on with what is left, so that every node costs one intersection. It
gives each node's members (a popcount), its smallest member and its end list
in the shard. Shards are merged by the fingerprint of a node's turns.

Sums over subtrees need no climb of the tree. A node belongs to its smallest
member; a conversation owns the nodes of its path from some depth on. Every
member that doesn't own a node saves the node's words, and every childless
node is owned by one conversation, so that n_leaves and saved_tokens are sums
over a node's members alone. A second descent adds them up, with the bitsets
of those that own no node at a depth and of those that own a childless one.

A conversation of any length is cut into segments of positions; a segment's
descent starts from the fingerprints of what comes before. End lists are
hashed in the order of shards by a task that holds one shard's list at a time
(a list's hash is sequential by its definition).

Defined results: null role or text is empty; a null turn comes first; turns
of one number go by the SHA-256 of length of role in bytes, ":", role and
text; repeated rows are turns of their own; rows without a conv_id take no
part; texts of any length are hashed whole in the first stage and not moved;
an empty table gives no rows, not even a root; further columns are left out.
Turns are equal if 128 bits of their SHA-256 are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm.common import written
from tracelake.llm.turns import numbered

#: Turns of a segment of positions, and of a shard in each segment.
SEGMENT, SHARD = 1024, 32_768
PARTIAL = "shard long, a long, b long, parent_a long, parent_b long, depth long, conv_id long, n_convs long, words long, ends binary"
SUMS = "a long, b long, n_leaves long, saved_tokens long"
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Bitmaps:
    """A shard's postings over the turns of one segment; bit i is the i-th conversation by id."""

    def __init__(self, pdf: pd.DataFrame, segment: int) -> None:
        pdf = pdf.sort_values(["conv_id", "pos"])
        self.ids, which = np.unique(pdf["conv_id"].to_numpy(), return_inverse=True)
        self.first = int(pdf["seg"].iloc[0]) * segment
        self.last = self.first + segment
        self.postings: dict[tuple[int, int, int], int] = {}
        self.turns: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.ending: dict[int, int] = {}
        self.roots: dict[tuple[int, int], int] = {}
        seen = -1
        for i, pos, a, b, words, in_a, in_b, length in zip(which.tolist(), *(pdf[c].tolist() for c in ("pos", "a", "b", "words", "in_a", "in_b", "length")), strict=True):
            bit = 1 << i
            if i != seen:
                seen = i
                self.ending[length] = self.ending.get(length, 0) | bit
                self.roots[in_a, in_b] = self.roots.get((in_a, in_b), 0) | bit
            if pos:
                self.postings[pos, a, b] = self.postings.get((pos, a, b), 0) | bit
                self.turns[i, pos] = (a, b, words)

    def nodes(self) -> Iterator[tuple[int, int, int, int, int, int, int, int]]:
        """(bitset, a, b, parent's a and b, depth, words, number of the parent among what is yielded, -1: none), parents first."""
        stack = [(bits, a, b, 0, 0, self.first, 0, -1) for (a, b), bits in self.roots.items()]
        number = 0
        while stack:
            node = stack.pop()
            yield node
            bits, a, b, _, _, depth, _, _ = node
            if depth < self.last:
                left = bits & ~self.ending.get(depth, 0)
                while left:
                    low = (left & -left).bit_length() - 1
                    x, y, words = self.turns[low, depth + 1]
                    child = left & self.postings[depth + 1, x, y]
                    left ^= child
                    stack.append((child, a ^ x, b ^ y, a, b, depth + 1, words, number))
            number += 1

    def members(self, bits: int) -> np.ndarray:
        raw = np.frombuffer(bits.to_bytes(len(self.ids) // 8 + 1, "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def _descend(pdf: pd.DataFrame, segment: int) -> pd.DataFrame:
    """Nodes as far as the shard has them."""
    maps, out = Bitmaps(pdf, segment), []
    shard = int(pdf["shard"].iloc[0])
    for bits, a, b, pa, pb, depth, words, parent in maps.nodes():
        if parent < 0 and maps.first:
            continue  # the segment before has this node
        ended = bits & maps.ending.get(depth, 0)
        ends = zlib.compress(np.diff(maps.ids[maps.members(ended)], prepend=0).tobytes(), 1) if ended else None
        out.append((shard, a, b, pa, pb, depth, int(maps.ids[(bits & -bits).bit_length() - 1]), bits.bit_count(), words, ends))
    return pd.DataFrame(out, columns=[c.split()[0] for c in PARTIAL.split(", ")])


def _sum(pdf: pd.DataFrame, segment: int) -> pd.DataFrame:
    """What a shard's conversations add to n_leaves and saved_tokens of its nodes."""
    maps = Bitmaps(pdf, segment)
    one = pdf.drop_duplicates("conv_id").sort_values("conv_id")
    leaf, later = 0, one["later"].to_numpy()
    sharing = [0] * (segment + 2)  # by depth - first: who owns no node there
    for i, (owns_from, owns_leaf) in enumerate(zip(one["owns_from"].tolist(), one["owns_leaf"].tolist(), strict=True)):
        leaf |= owns_leaf << i
        if owns_from > maps.first:
            sharing[min(owns_from - maps.first, segment + 1) - 1] |= 1 << i
    for d in range(segment, -1, -1):
        sharing[d] |= sharing[d + 1]
    nodes, leaves, saved = [], [], []
    for bits, a, b, _, _, depth, words, parent in maps.nodes():
        nodes.append((a, b, parent))
        leaves.append((bits & leaf).bit_count())
        own = words * (bits & sharing[depth - maps.first]).bit_count()
        saved.append(own + (int(later[maps.members(bits)].sum()) if depth == maps.last else 0))
    for n in range(len(nodes) - 1, -1, -1):
        if nodes[n][2] >= 0:
            saved[nodes[n][2]] += saved[n]
    out = [(a, b, x, s) for (a, b, parent), x, s in zip(nodes, leaves, saved, strict=True) if (x or s) and (parent >= 0 or not maps.first)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in SUMS.split(", ")])


def _hash_ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """a, b, ends_sha256 of end lists that come sorted by (a, b, shard)."""
    now, digest, last = None, None, None
    for pdf in frames:
        done = []
        for a, b, ends in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["ends"], strict=True):
            if (a, b) != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest, last = (a, b), hashlib.sha256(), ""
            ids = np.frombuffer(zlib.decompress(ends), np.int64).cumsum().tolist()
            digest.update((last + ",".join(map(str, ids))).encode())
            last = ","
        yield pd.DataFrame(done, columns=["a", "b", "ends_sha256"])
    if now is not None:
        yield pd.DataFrame([(*now, digest.hexdigest())], columns=["a", "b", "ends_sha256"])


def conversation_turns(spark: SparkSession, conversations: DataFrame, **names: str) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) for trie(): the conversations as they are."""
    turns, runs = numbered(spark, conversations, **names)
    convs = runs.groupBy("conv_id").agg(F.sum("n").alias("length"), F.min("part").alias("part"))
    return turns.select("conv_id", "pos", "key", "words"), convs


def with_shared_heads(spark: SparkSession, conversations: DataFrame, every: int, most: int, head: Column, **names: str) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) for trie(), each conversation c rebuilt with a head of another.

    The first ``head`` turns (a column of conv_id, below ``most``) are those
    of conversation ``c - c % every``, all if it has fewer; then follow c's own
    turns after its first ``head``.
    """
    turns, runs = numbered(spark, conversations, **names)
    turns = written(spark, turns, "numbered-turns")
    convs = runs.groupBy("conv_id").agg(F.sum("n").alias("n"), F.min("part").alias("first_part"))
    convs = convs.withColumn("head", head.cast("int")).withColumn("source", F.col("conv_id") - F.col("conv_id") % every)
    first = turns.where((F.col("pos") < most) & (F.col("conv_id") % every == 0))
    heads = first.groupBy(F.col("conv_id").alias("source")).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "words"))).alias("turns"))
    taken = F.slice(F.coalesce("turns", F.expr("CAST(array() AS array<struct<pos: bigint, key: binary, words: bigint>>)")), F.lit(1), F.col("head"))
    convs = convs.join(heads, "source", "left").withColumn("turns", taken).withColumn("gone", F.col("head") - F.size("turns"))
    convs = written(spark, convs.withColumn("length", F.size("turns") + F.greatest(F.col("n") - F.col("head"), F.lit(0))), "rebuilt")
    # By (part, conv_id): a long conversation is in many parts.
    moved = runs.select("part", "conv_id").join(convs.select("conv_id", "head", "gone"), "conv_id")
    own = turns.join(moved, ["part", "conv_id"]).where(F.col("pos") > F.col("head"))
    given = convs.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.pos", "t.key", "t.words")
    rows = own.select("conv_id", (F.col("pos") - F.col("gone")).alias("pos"), "key", "words").unionByName(given)
    return rows, convs.select("conv_id", "length", F.col("first_part").alias("part"))


def trie(spark: SparkSession, turns: DataFrame, convs: DataFrame, segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    turns: conv_id, pos (from 1, gapless), key, words; convs: conv_id, length,
    part (ascending with conv_id), all conversations, also those without turns.
    """
    so_far = Window.partitionBy("part").orderBy("conv_id").rowsBetween(Window.unboundedPreceding, -1)
    size = F.least(F.greatest("length", F.lit(1)), F.lit(segment))
    cut = F.floor(F.coalesce(F.sum(size).over(so_far), F.lit(0)) / shard)
    convs = written(spark, convs.withColumn("shard", F.shiftleft(F.col("part").cast("long"), 32) + cut).select("conv_id", "length", "shard"), "trie-convs")
    rows = turns.withColumn("seg", F.floor((F.col("pos") - 1) / segment)).withColumns({"a": F.xxhash64(F.lit(1), "pos", "key"), "b": F.xxhash64(F.lit(2), "pos", "key")}).drop("key")
    earlier = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    segs = rows.groupBy("conv_id", "seg").agg(F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y"))
    segs = segs.select("conv_id", "seg", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(n) for c, n in (("x", "in_a"), ("y", "in_b"))))
    bare = convs.where(F.col("length") == 0).select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("pos", "words", "seg", "a", "b", "in_a", "in_b")), "length", "shard")
    placed = rows.join(segs.join(convs, "conv_id"), ["conv_id", "seg"]).unionByName(bare)
    placed = written(spark, placed, "trie-turns")

    found = written(spark, placed.groupBy("shard", "seg").applyInPandas(lambda pdf: _descend(pdf, segment), PARTIAL), "trie-shards")
    same = ("parent_a", "parent_b", "depth", "words")
    nodes = found.groupBy("a", "b").agg(*(F.min(c).alias(c) for c in same), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    children = nodes.where("depth > 0").groupBy(F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(spark, nodes.join(children, ["a", "b"], "left").fillna(0, ["n_children"]), "trie-nodes")

    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("owns_from"), F.max((F.col("n_children") == 0).cast("int")).alias("owns_leaf"))
    owners = convs.join(owned, "conv_id", "left").select("conv_id", F.coalesce("owns_from", F.col("length") + 1).alias("owns_from"), F.coalesce("owns_leaf", F.lit(0)).alias("owns_leaf"))
    pieces = placed.groupBy("conv_id", "seg").agg(F.count(F.lit(1)).alias("_")).drop("_").join(owners, "conv_id")
    owning = placed.join(pieces, ["conv_id", "seg"])
    after = Window.partitionBy("conv_id").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    shared = owning.groupBy("conv_id", "seg").agg(F.coalesce(F.sum(F.when(F.col("pos") < F.col("owns_from"), F.col("words"))), F.lit(0)).alias("w"))
    later = shared.select("conv_id", "seg", F.coalesce(F.sum("w").over(after), F.lit(0)).alias("later"))
    sums = owning.join(later, ["conv_id", "seg"]).groupBy("shard", "seg").applyInPandas(lambda pdf: _sum(pdf, segment), SUMS)
    sums = sums.groupBy("a", "b").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    lists = found.where(F.col("ends").isNotNull()).select("a", "b", "shard", "ends")
    ends = lists.repartition("a", "b").sortWithinPartitions("a", "b", "shard").mapInPandas(_hash_ends, "a long, b long, ends_sha256 string")
    whole = nodes.join(sums, ["a", "b"], "left").join(ends, ["a", "b"], "left")
    parents = nodes.select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"))
    return whole.join(parents, ["parent_a", "parent_b", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
