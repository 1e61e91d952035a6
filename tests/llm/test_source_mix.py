import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import source_mix


def wanted_targets(sizes):
    """Targets by source, the contract's words step by step."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, open_ = float(sum(sizes.values())), set(order)
    while open_ and left > 1e-9:
        w = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / w
        left = 0.0
        for s in list(open_):
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 4)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 120))
@settings(max_examples=100, deadline=None)
def test_knapsack_is_optimal(items, budget):
    lengths, counts = [x for x, _ in items], [n for _, n in items]
    taken = source_mix.bounded_knapsack(lengths, counts, budget)
    assert all(0 <= t <= n for t, n in zip(taken, counts, strict=True))
    total = sum(x * t for x, t in zip(lengths, taken, strict=True))
    best = max(s for c in product(*(range(n + 1) for n in counts)) if (s := sum(x * t for x, t in zip(lengths, c, strict=True))) <= budget)
    assert total == best


@pytest.mark.parametrize("knapsack", [50, 65536])
def test_budgets_are_met(knapsack):
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(rng.integers(1, 900, 400), return_counts=True)
    for budget in (0, 777, 50_000, int((lengths * counts).sum()), 10**9):
        take = source_mix.fit_budget(lengths, counts, budget, knapsack)
        assert all(0 <= t <= n for t, n in zip(take, counts, strict=True))
        assert sum(x * t for x, t in zip(lengths.tolist(), take, strict=True)) == min(budget, int((lengths * counts).sum()))


def test_long_documents_meet_the_budget():
    lengths, counts = np.array([100_003, 100_019, 100_043, 250_007]), np.full(4, 40)
    take = source_mix.fit_budget(lengths, counts, 1_000_000)
    best = max(
        s for c in product(range(10), range(10), range(10), range(5)) if (s := sum(int(x) * t for x, t in zip(lengths, c, strict=True))) <= 1_000_000
    )
    assert sum(int(x) * t for x, t in zip(lengths, take, strict=True)) == best >= 950_027


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 9)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 700), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_the_best_sum_is_found_from_any_window(items, budget, window):
    lengths, counts = [x for x, _ in items], [n for _, n in items]
    take = source_mix.fit_budget(np.array(lengths), np.array(counts), budget, window)
    reach = {0}
    for x, n in items:
        reach = {r + x * t for r in reach for t in range(n + 1)}
    assert all(0 <= t <= n for t, n in zip(take, counts, strict=True))
    assert sum(x * t for x, t in zip(lengths, take, strict=True)) == max(r for r in reach if r <= budget)


@pytest.mark.parametrize("broadcast", [source_mix.BROADCAST, 0])
def test_mixed_documents_take_what_the_mix_plans(spark, docs, broadcast):
    """Also with repeated rows, ids and null ids."""
    many = docs.union(docs.where("doc_id IN (9, 12)")).union(docs.where("doc_id IS NULL"))
    plan = source_mix.mix(spark, many).toPandas()
    got = source_mix.mixed_documents(spark, many, broadcast=broadcast).toPandas()
    size = got["text"].map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    assert len(got) == plan["copies"].sum() and size.sum() == plan["taken"].sum()
    want = plan.groupby([plan["doc_id"].fillna(-1), "size"])["copies"].sum()
    have = got.groupby([got["doc_id"].fillna(-1), size]).size()
    assert {k: v for k, v in want.items() if v} == dict(have.items())


def test_contract(spark, docs, rows):
    got = source_mix.mix(spark, docs).toPandas()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = wanted_targets(sizes)
    assert sorted(zip(got["doc_id"].fillna(-1), got["size"], strict=True)) == sorted((-1 if r[0] is None else r[0], size(r[1])) for r in rows)
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
    for source, part in got.groupby(got["source"].where(got["source"].notna(), "?"), dropna=False):
        s = None if source == "?" else source
        assert part["source_size"].eq(sizes[s]).all()
        assert part["target"].iloc[0] == pytest.approx(want[s])
        assert abs(part["taken"].sum() - want[s]) <= max(2, part["size"].max() / 2)
    again = source_mix.mix(spark, docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, again[key].fillna(-1).to_numpy().tolist())) == sorted(map(tuple, got[key].fillna(-1).to_numpy().tolist()))


def test_caps_reshare(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1, "a"), (2, "b"), (500, "c"), (3, "d"), (0, "e")])]
    got = source_mix.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas().set_index("source")
    want = wanted_targets({s: n for n, s in [(1, "a"), (2, "b"), (500, "c"), (3, "d"), (0, "e")]})
    assert {s: got.loc[s, "target"] for s in want} == pytest.approx(want)


def test_mixed_documents_and_empty_table(spark, docs, empty):
    mixed = source_mix.mixed_documents(spark, docs)
    assert mixed.columns == docs.columns
    assert source_mix.mix(spark, empty).count() == 0
    assert source_mix.mixed_documents(spark, empty).count() == 0


def test_many_distinct_lengths_meet_the_budget():
    lengths = np.arange(1, 20_001)
    counts = np.full(20_000, 3)
    budget = int((lengths * counts).sum() * 0.37)
    assert int((lengths * source_mix.fit_budget(lengths, counts, budget)).sum()) == budget


@pytest.mark.parametrize("n, most", [(50, 0.3), (400, 0.1), (5000, 0.05)])
def test_documents_of_all_lengths_are_taken_alike(n, most):
    """Each quarter of a source's documents by length is taken at the source's share; budgets are met."""
    rng = np.random.default_rng(n)
    for share in (0.1, 0.35, 0.5, 0.72):
        sizes = np.sort(np.maximum(1, rng.lognormal(5, 1.1, n).astype(int)))
        lengths, counts = np.unique(sizes, return_counts=True)
        budget = round(share * sizes.sum())
        take = np.array(source_mix.fit_budget(lengths, counts, budget))
        assert budget - (take * lengths).sum() <= (1 if n == 50 else 0)
        quarter = (np.cumsum(counts) - 1) * 4 // n
        taken = [take[quarter == q].sum() / counts[quarter == q].sum() for q in range(4)]
        assert max(abs(t - share) for t in taken) <= most, (share, taken)
