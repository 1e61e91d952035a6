"""The trie against a plain walk over lists of turns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracelake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, a long, shard int, part int, seg long, pos long, length int, words string, key string"
OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            out[conv].append(((turn is not None, turn or 0, key[:32]), (role, text)))
    return {c: [x for _, x in sorted(ts)] for c, ts in out.items()}


def rebuilt(convs):
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
    return {c: convs.get(c - c % 20, [])[: h[c]] + ts[h[c] :] for c, ts in convs.items()}


def plain(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(own) - 1) * words
    rows = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        rows.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=lambda r: r[:2])


def got(df):
    return sorted((tuple(r[c] for c in OUT) for r in df.collect()), key=lambda r: r[:2])


def made(seed=3):
    rng = random.Random(seed)
    rows = []
    openings = [[("system", "you are kind"), ("user", "hello there"), ("assistant", "hi"), ("user", "bye")], [("user", "hello there"), ("assistant", "what is it")], [("user", None), (None, "x y")]]
    for c in rng.sample(range(200), 120):
        turns = list(rng.choice(openings)) if rng.random() < 0.8 else []
        turns = turns[: rng.randrange(1, 5)] + [(rng.choice(["user", "assistant"]), f"word{rng.randrange(3)} " * rng.randrange(0, 4)) for _ in range(rng.randrange(0, 4))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(300, None, "user", "first"), (300, 5, "user", "second"), (300, 5, "user", "also second"), (300, 5, "user", "second"), (300, -3, "user", "before")]
    rows += [(301, None, "user", "first"), (None, 0, "user", "hello there"), (None, None, None, None), (302, 0, "user", "é 日本 " * 30_000)]
    rows += [(400 + i, t, "user", f"turn {t}") for i in range(3) for t in range(40 - i)]  # longer than a segment of the test
    rows += [rows[0], rows[1]]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, "w", "k") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("segment, shard", [(prefix_trie.SEGMENT, prefix_trie.SHARD), (3, 20)])
def test_rebuilt_trie_equals_plain_walk(spark, segment, shard):
    """Also where conversations are longer than segments, and shards hold few of them."""
    rows = made()
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    turns, convs = prefix_trie.with_shared_heads(spark, frame(spark, rows), every=20, most=4, head=head)
    assert got(prefix_trie.trie(spark, turns, convs, segment, shard)) == plain(rebuilt(conversations(rows)))


def test_conversations_as_they_are(spark):
    rows = made(8)
    turns, convs = prefix_trie.conversation_turns(spark, frame(spark, rows))
    assert got(prefix_trie.trie(spark, turns, convs, 4, 50)) == plain(conversations(rows))


def test_copies_in_many_shards(spark):
    """One opening of all conversations, one conversation that most copy: end lists span shards in the order of ids."""
    rows = [(c, t, "user", f"same {t}") for c in range(-30, 300) for t in range(3)] + [(c, 3, "user", f"own {c}") for c in range(0, 300, 10)]
    turns, convs = prefix_trie.conversation_turns(spark, frame(spark, rows))
    assert got(prefix_trie.trie(spark, turns, convs, 2, 16)) == plain(conversations(rows))


def test_empty(spark):
    turns, convs = prefix_trie.conversation_turns(spark, spark.createDataFrame([], SCHEMA))
    assert prefix_trie.trie(spark, turns, convs).count() == 0


def test_every_node_costs_one_intersection():
    """The descent meets each node once, with the members a set intersection gives."""
    import pandas as pd

    rng = random.Random(1)
    rows = [(c, p, rng.randrange(2), 0, 1, 0, 0, 5, 0) for c in range(40) for p in range(1, 6)]
    pdf = pd.DataFrame(rows, columns=["conv_id", "pos", "a", "b", "words", "in_a", "in_b", "length", "seg"])
    maps = prefix_trie.Bitmaps(pdf, 100)
    found = list(maps.nodes())
    paths = {c: tuple(g["a"]) for c, g in pdf.groupby("conv_id")}
    expected = {p[:d] for p in paths.values() for d in range(6)}
    assert len(found) == len(expected)
    assert sum(n[0].bit_count() for n in found if n[5] == 5) == 40
