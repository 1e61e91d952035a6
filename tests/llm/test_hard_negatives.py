"""Exact scores by residues against whole Python numbers, selections against a plain loop."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<float>, label int, v int, row int, dim string, block int, place int, score double, positives int"


@pytest.mark.parametrize("top, dim", [(0, 3), (1, 1), (135, 64), (30_000, 64), (2**31 - 1, 7), (2**44, 5), (90, 3000), (5, 0)])
def test_scores_are_exact(top, dim):
    rng = np.random.default_rng(top + dim)
    a, b = (rng.integers(-top, top + 1, (n, dim)).astype(np.float64) for n in (4, 9))
    a[:1], b[:1] = top, -top  # the largest score there can be, negative
    scorer = hard.Scorer(b, int(np.abs(a).max()) if a.size else 0)
    exact = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    clamped = [[max(-hard.LONG - 1, min(hard.LONG, s)) for s in r] for r in exact]
    assert scorer.scores(a).tolist() == clamped


def test_sums_stay_exact_in_float32():
    """The largest residues, in vectors longer than a slab."""
    p = hard.PRIMES[0]
    x = np.full((1, 5000), p // 2, np.float32)
    assert hard.modular_product(x, x, p)[0, 0] == 5000 * (p // 2) ** 2 % p
    assert math.prod(hard.primes_for(10**400)) > 2 * 10**400


def plain(rows):
    kept = []
    for i, (vec, e, label) in enumerate(rows):
        if vec is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, vec, (label + 1) % 10 if vec % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for i, vec, label, e in kept:
        if vec % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(e, f, strict=True)), w, m) for j, w, m, f in kept if j != i and len(f) == len(e)), key=lambda s: s[:2])
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            window = [(-s, w) for s, w, m in scored if m != label and 50 * -ps <= 100 * -s <= 95 * -ps]
            out += [(vec, p, n + 1, w, -ps, s) for n, (s, w) in enumerate(window[:3])]
    return sorted(out)


def run(spark, rows):
    rows = [(v, None if e is None else [None if x is None else float(x) for x in e], m) for v, e, m in rows]
    df = spark.createDataFrame([(*r, 1, 2, "d", 3, 4, 0.5, 6) for r in rows], SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hard.hard_negatives(spark, hard.sound(spark, df, label), F.col("vec_id") % 50 == 0)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def made():
    rng = random.Random(4)
    center = {c: [rng.gauss(0.1, 0.2) for _ in range(6)] for c in range(10)}
    rows = [(i, [x + rng.gauss(0, 0.15) for x in center[i % 3 or 1]], i % 3) for i in range(600)]
    rows += [(1000 + i, [0.25] * 6, i % 2) for i in range(60)]  # ties
    rows += [(2000, None, 1), (2050, [0.1] * 6, None), (None, [0.1] * 6, 1), (2100, [], 1), (2101, [], 2), (2102, [], 1), (2150, [0.1, None, 1, 1, 1, 1], 1)]
    rows += [(2200, [float("nan")] * 6, 1), (2250, [float("inf")] * 6, 1), (2300, [0.5, 0.5], 4), (2301, [0.5, 0.25], 4), (2302, [0.5, 0.0], 5), (2350, [-1.0, 1.0], 4), (2351, [1.0, 1.0], 4)]
    return rows + [rows[50], rows[3]]


def test_equals_plain_loop(spark):
    rows = made()
    assert run(spark, rows) == plain(rows)


def test_small_blocks(spark, monkeypatch):
    """Labels over many blocks; blocks of one label meet no anchors of theirs for negatives."""
    for name, n in (("BLOCK", 40), ("ANCHORS", 3)):
        monkeypatch.setattr(hard, name, n)
    rows = made()
    assert run(spark, rows) == plain(rows)


def test_huge_components(spark):
    rows = [(i, [3e38 * (-1) ** i, 1e-3], i % 2) for i in range(0, 60, 5)]
    top = hard.LONG
    assert all(abs(r[4]) <= top + 1 and abs(r[5]) <= top + 1 for r in run(spark, rows))


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(50, [0.5], 1)]) == []
