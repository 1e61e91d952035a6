import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracelake.llm import ngram_join


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_force(rows):
    """(doc_id, n_shingles, component_id, n_links) of every row; null ids are -1."""
    sets = [shingles(r[1]) for r in rows]
    near, links = defaultdict(set), Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
                near[rows[i][0]].add(rows[j][0])
                near[rows[j][0]].add(rows[i][0])
                links[i] += 1
                links[j] += 1
    out = []
    for i, r in enumerate(rows):
        seen, todo = {r[0]}, [r[0]]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((-1, len(sets[i]), -1, 0) if r[0] is None else (r[0], len(sets[i]), min(seen), links[i]))
    return sorted(out)


def result(spark, docs):
    return sorted(tuple(-1 if x is None else x for x in r) for r in ngram_join.join(spark, docs).collect())


def test_equals_brute_force(spark, docs, rows):
    """Repeated ids, with equal and with other texts, included."""
    assert result(spark, docs) == brute_force(rows)


def test_repeated_ids_share_a_component(spark, docs):
    text, other = ("a b c d e f g h i j", "k l m n o p q r s t")
    rows = [(3, text), (9, other), (9, text), (12, other), (9, ""), (15, "u v w x y z")]
    got = result(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r[2] for r in got] == [3, 3, 3, 3, 3, 15]


def test_near_copies_in_many_blocks(spark, monkeypatch):
    """A large group of near copies is dealt as pairs of blocks and loses no link."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(ngram_join, "BUCKET", 1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(spark, docs) == brute_force(rows)


def test_threshold_is_exact(spark):
    """Three of four shingles shared of a union of four: similarity 0.75 links."""
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g"), (3, "a b c d e f"), (4, "q r"), (5, "Q R"), (6, "q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(spark, docs) == brute_force(rows)


@pytest.mark.parametrize("seed", range(5))
def test_trie_links(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(60):
        base = sets[rng.integers(len(sets))] if sets and rng.random() < 0.7 else rng.choice(500, rng.integers(1, 40), replace=False).astype(np.uint64)
        keep = base[rng.random(len(base)) < 0.9]
        sets.append(np.unique(np.concatenate([keep, rng.choice(500, rng.integers(0, 4), replace=False).astype(np.uint64), [np.uint64(900)]])))
    similar = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    counted = [(g, (g % np.uint64(7)).astype(np.uint8)) for g in sets]  # counts over all buckets order the n-grams
    pairs = lambda left, right: sorted((int(i), j) for who, j in ngram_join.linked(left, right) for i in who)
    assert pairs(counted, None) == [(i, j) for i in range(60) for j in range(i + 1, 60) if similar(sets[i], sets[j])]
    assert pairs(counted[:25], counted[25:]) == [(i, j) for i in range(25) for j in range(35) if similar(sets[i], sets[25 + j])]


def test_pairs_that_met_in_a_smaller_centre():
    centres = [np.array(c) for c in ([1, 5, 9], [5, 9], [9], [1, 9], [2, 9], [2, 5, 9])]
    want = [[bool({c for c in a if c < 9} & set(b)) for b in map(set, centres)] for a in centres]
    got = ngram_join.met_before(centres, 9)
    assert (got == np.array(want)).all()
    assert ngram_join.met_before([np.array([3, 9]), np.array([4, 9])], 9) is None


def test_pairs_that_met_take_no_memory_of_all_pairs():
    """Short texts: thousands of sets in a bucket."""
    centres = [np.array([i % 700, 1000 + i % 3, 9999]) for i in range(6000)]
    tracemalloc.start()
    got = ngram_join.meetings(centres, 9999)(np.arange(64, 128))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [[i % 700 == j % 700 or i % 3 == j % 3 for j in range(6000)] for i in range(64, 128)]
    assert (got == np.array(want)).all() and most < 20e6  # a whole matrix of bits or floats: 36 or 144 MB


def test_word_hashes_keep_no_words():
    from tracelake.llm.common import WordHashes

    known = WordHashes.kept()
    tracemalloc.start()
    for i in range(100):
        assert len(known.of([b"w%d" % j for j in range(1000 * i, 1000 * i + 1000)])) == 1000
    left = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert left < 1e6 and known.of([b"a", b"b"]).tolist() == [ngram_join.xxhash.xxh3_64_intdigest(w) for w in (b"a", b"b")] and not len(known.of([]))


def test_one_of_each_keeps_smallest_ids(spark, docs, rows):
    kept = ngram_join.one_of_each(spark, docs)
    assert kept.columns == docs.columns
    gone = {r[0] for r in brute_force(rows) if r[2] < r[0]} - {9}
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not gone & ids
    assert ids | gone | {9} == {r[0] for r in rows} | {9}


def test_empty_table(spark, empty):
    assert ngram_join.join(spark, empty).count() == 0
