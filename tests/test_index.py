"""The stored index against a plain evaluation of each text, through updates, deletions and compaction."""

import itertools
import math
import os
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tracelake.operators import index
from tracelake.operators.index import Every, Near, Phrase, Some, Without, word
from tracelake.operators.search import K1, B


def terms(text):
    bare = "".join(c for c in unicodedata.normalize("NFD", text or "") if not unicodedata.combining(c))
    return [t for t in re.split(r"[^\w-]+", bare.lower()) if t]


def starts(t, p):
    fits = lambda x, i: x.startswith(p.words[i]) if p.prefix and i == len(p.words) - 1 else x == p.words[i]
    return [i for i in range(len(t) - len(p.words) + 1) if all(fits(t[i + j], j) for j in range(len(p.words)))]


def holds(t, what):
    match what:
        case Phrase():
            return bool(starts(t, what))
        case Near():
            clumps = itertools.product(*(starts(t, p) for p in what.phrases))
            return any(all(max(c) - x - len(p.words) <= what.within for x, p in zip(c, what.phrases, strict=True)) for c in clumps)
        case Every():
            return all(holds(t, x) for x in what.parts)
        case Some():
            return any(holds(t, x) for x in what.parts)
        case Without():
            return holds(t, what.what) and not holds(t, what.excluded)


def plain(docs, what):
    docs = {i: terms(t) for i, t in docs.items()}
    n, total, out = len(docs), sum(map(len, docs.values())), {}
    for i, t in docs.items():
        if holds(t, what):
            score = 0.0
            for p in index.phrases(what):
                df, f = sum(bool(starts(x, p)) for x in docs.values()), len(starts(t, p))
                score -= max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(t) / (total / n)))
            out[i] = round(score, 9)
    return out


SEARCHES = [
    word("ab"), Phrase(("ab", "ac")), Phrase(("a",), True), Phrase(("ab", "b"), True), Near((word("ab"), word("bc")), 2), Near((word("ab"), word("ab")), 1),
    Near((Phrase(("ab", "ac")), word("cc"), Phrase(("b",), True)), 3), Every((word("ab"), word("cc"))), Some((word("zz"), Every((word("bb"), word("ca"))))),
    Without(Some((word("ab"), word("bb"))), Phrase(("ac", "a"), True)), word("eleve"), word("snake_case"), Near((word("zz"), word("ab")), 5),
]


def made(seed, n):
    rng = random.Random(seed)
    vocabulary = [a + b for a in "abc" for b in "abc"]
    return {i: " ".join(rng.choices(vocabulary, k=rng.randrange(0, 25))) for i in range(n)}


def frame(spark, docs, **more):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()] + list(more.get("rows", ())), "doc_id long, text string, term string, version int")


@pytest.fixture(scope="module")
def upkept(spark, tmp_path_factory):
    """(folder, the documents that it should hold) after three batches, the second of them written twice."""
    folder = str(tmp_path_factory.mktemp("index"))
    docs = made(1, 80) | {90: "Élève, élevé! naïve", 91: None, 92: "a snake_case kebab-case x", 93: "ab " * 500}
    index.update(spark, folder, frame(spark, docs, rows=[(None, "ab", "x", 1), (5, docs[5], "x", 1)]), 0)
    changed = {i: t for i, t in made(2, 100).items() if i % 3 == 0}
    for _ in range(2):
        index.update(spark, folder, frame(spark, changed), 1)
    docs |= changed
    gone = spark.createDataFrame([(i,) for i in range(0, 100, 4)], "doc_id long")
    again = {i: "ab ac cc once more" for i in range(1, 100, 10)}
    index.update(spark, folder, frame(spark, again), 2, deleted=gone)
    docs = {i: t for i, t in docs.items() if i % 4} | again
    return folder, docs


def scores(spark, folder, what):
    return {r["doc_id"]: round(r["score"], 9) for r in index.matched(spark, folder, what).collect()}


@pytest.mark.parametrize("what", SEARCHES, ids=str)
def test_index_equals_texts(spark, upkept, what):
    folder, docs = upkept
    assert scores(spark, folder, what) == plain(docs, what)


def test_compaction_changes_no_result(spark, upkept, tmp_path):
    folder, docs = upkept
    index.compact(spark, folder, str(tmp_path))
    for what in SEARCHES[3:8]:
        assert scores(spark, str(tmp_path), what) == plain(docs, what)


def test_reads_only_the_buckets_of_its_terms(spark, upkept):
    folder, _ = upkept
    read = index.postings(spark, folder, ["ab"], [])
    bucket = spark.range(1).select(index.bucket_of(F.lit("ab"))).first()[0]
    assert {r[0] for r in read.select("bucket").distinct().collect()} == {bucket}
    plan = read._jdf.queryExecution().toString()
    assert f"PartitionFilters: [isnotnull(bucket" in plan or f"= {bucket})" in plan
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,ab)" in plan or "In(term, [ab])" in plan


def test_hits_gates_and_counts(spark, upkept):
    folder, docs = upkept
    events = spark.createDataFrame([(i, i % 7, "claude" if i % 2 else "codex", f"2024-01-{i % 28 + 1:02d}") for i in docs], "id long, session long, client string, event_at string")
    sessions = spark.createDataFrame([(0, "pending_review", None), (1, "embargoed", None), (2, "embargoed", "2024-01-01"), (3, "embargoed", "2030-01-01"), (4, "released", None)], "session long, hold_state string, embargo_until string")
    among = index.allowed(events, "id", F.lit("2024-06-01"), sessions, since=F.lit("2024-01-05"), client=("claude",))
    shown = {i for i in docs if i % 7 not in (0, 1, 3) and i % 2 and i % 28 + 1 >= 5}
    assert {r[0] for r in among.collect()} == shown
    best = sorted((s, i) for i, s in plain(docs, word("ab")).items() if i in shown)
    hits = index.search(spark, folder, index.Request(word("ab"), 5), among).collect()
    assert [(round(r["score"], 9), r["doc_id"]) for r in hits] == best[:5]
    assert {r["rows_matched"] for r in hits} == {len(best)}
    everything = index.allowed(events, "id", F.lit("2024-06-01"), sessions, include_held=True)
    assert everything.count() == len(docs)


@pytest.mark.parametrize("wrong", [dict(limit=0), dict(limit=1001), dict(snippet_terms=0), dict(snippet_terms=65)])
def test_limits(wrong):
    with pytest.raises(ValueError):
        index.Request(word("a"), **wrong)
    with pytest.raises(ValueError):
        index.Request(word("a" * 4096))
    with pytest.raises(ValueError):
        Phrase(())


def test_empty_index(spark, tmp_path):
    index.update(spark, str(tmp_path), frame(spark, {}), 0)
    assert index.search(spark, str(tmp_path), index.Request(word("ab"))).count() == 0
    assert index.search(spark, f"{tmp_path}/none", index.Request(word("ab"))).count() == 0
    assert os.path.isdir(f"{tmp_path}/docs")


def test_a_frequent_term_is_a_row_for_each_block(spark, tmp_path):
    docs = {i: "ab ac ab" if i % 2 else "ab" for i in range(3000)}
    index.update(spark, str(tmp_path), frame(spark, docs), 0)
    index.update(spark, str(tmp_path), frame(spark, {}), 1, deleted=spark.createDataFrame([(i,) for i in range(0, 3000, 3)], "doc_id long"))
    index.compact(spark, str(tmp_path), f"{tmp_path}/compact")
    for folder in (str(tmp_path), f"{tmp_path}/compact"):
        stored = spark.read.parquet(f"{folder}/postings").where("term = 'ab'")
        assert stored.count() <= 3000 / 100
        got = {r["doc_id"]: (r["length"], r["positions"]) for r in index.postings(spark, folder, ["ab"], []).collect()}
        assert got == {i: (3, [0, 2]) if i % 2 else (1, [0]) for i in range(3000) if i % 3}
