import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import topk_search

SCHEMA = "vec_id long, embedding array<float>, label int, `row` int, v string, shard int"


def brute_force(rows, k):
    sound = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(sound):
        if q % 50 == 0:
            scores = sorted((-int(a @ b), i) for m, (i, b) in enumerate(sound) if m != n and len(a) == len(b))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, **sizes):
    df = spark.createDataFrame([(i, v, 1, 2, "v", 3) for i, v in rows], SCHEMA)
    vectors = topk_search.prepared(spark, df)
    return sorted(map(tuple, topk_search.top_k(spark, vectors, vectors.where(F.col("vec_id") % 50 == 0), 5, **sizes).collect()))


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 60, "block_rows": 2}])
def test_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i % 7][1]) for i in range(60)]  # ties
    rows += [(None, [1.0] * 6), (400, None), (401, [1.0, None] * 3), (402, [float("nan")] * 6), (450, [float("inf")] * 6)]
    rows += [(500, [1.0, 2.0]), (501, [2.0, 2.0]), (550, []), (551, [])]
    assert found(spark, rows, **sizes) == brute_force(rows, 5)


def test_repeated_query_rows_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [0.5, 0.5])]
    assert found(spark, rows) == brute_force(rows, 5)


def test_large_components_are_exact(spark):
    rows = [(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [3e6, 1.0])]
    assert found(spark, rows) == brute_force(rows, 5)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_bounds_prune(spark):
    """Far balls are not opened: every leaf beyond the best holds smaller products."""
    rng = np.random.default_rng(2)
    near, far = rng.normal(size=(200, 4)) + 50, rng.normal(size=(2000, 4)) - 50
    vectors = np.floor(np.vstack([near, far]))
    tree, opened = topk_search.BallTree(vectors, 16), []
    tree.nodes = Counted(tree.nodes, opened)
    q, i, s = topk_search.search_shard(tree, np.arange(2200), np.arange(2200), vectors, np.array([-1]), np.full((1, 4), 9.0), np.array([-np.inf]), 3)
    want = sorted(((-x, n) for n, x in enumerate(vectors @ np.full(4, 9.0))))[:3]
    assert [(-a, b) for a, b in zip(s, i, strict=True)] == want
    assert len(set(opened)) < len(tree.nodes) / 4


class Counted(list):
    def __init__(self, nodes, opened):
        super().__init__(nodes)
        self.opened = opened

    def __getitem__(self, n):
        self.opened.append(n)
        return super().__getitem__(n)


def test_queries_go_only_to_shards_that_their_bound_reaches(spark, monkeypatch):
    """Ten far clusters: pairs of queries and shards grow with the cluster's shards, not with all shards."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(10, 8)) * 100
    rows = [(i, (centers[i % 10] + rng.normal(size=8)).tolist()) for i in range(3000)]
    counts, plain = {}, topk_search.written

    def counted(spark, df, name):
        out = plain(spark, df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(topk_search, "written", counted)
    assert found(spark, rows, shard_rows=100) == brute_force(rows, 5)
    queries = sum(i % 50 == 0 for i, _ in rows)
    assert counts["topk-trees"] >= 30 and counts["topk-first"] == queries
    assert counts["topk-pairs"] < queries * counts["topk-trees"] / 4
