import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest

from tracelake.llm import common
from tracelake.llm import quality_classifier as qc


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    pos = label == 1
    return (rank[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


@pytest.fixture(scope="module")
def scored(spark, medium):
    docs, labels = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("documents", "labels"))
    return qc.scored(spark, docs, labels).toPandas(), labels.toPandas()


def test_held_out_documents_are_told_apart(scored):
    got, labels = scored
    both = got.merge(labels, on="doc_id")
    held = both[both["held_out"]]
    assert auc(held["score"].to_numpy(), held["quality"].to_numpy()) > 0.95
    assert ((held["predicted"] == held["quality"]).mean()) > 0.9


def test_contract(scored):
    got, _ = scored
    assert got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()


def test_rows_that_break_nothing(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(7, 1), (None, 1), (8, None)], "doc_id long, quality int")
    got = qc.scored(spark, docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert qc.scored(spark, empty, labels).count() == 0
    none = qc.scored(spark, docs, labels.limit(0)).toPandas()
    assert (none["score"] == 0.5).all()
    kept = qc.accepted(spark, docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_isotonic_is_the_best_ascending_fit():
    rng = np.random.default_rng(0)
    x, w = np.arange(30.0), rng.integers(1, 5, 30).astype(float)
    y = rng.random(30) + x / 40
    knots, values = qc.isotonic(x, y, w)
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
    # Means of blocks between any two cuts: the min-max formula.
    best = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert np.allclose(np.unique(np.round(best, 9)), np.round(values, 9))


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(qc.SEED)
    d = qc.N_STATISTICS
    omega, phase = rng.normal(size=(d, 4000)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, 4000)
    model = qc.Model(np.zeros(d), np.ones(d), omega, phase, np.zeros(4001), np.empty(0), np.empty(0))
    x = rng.normal(size=(6, d))
    z = model.features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * d))
    assert np.abs(z @ z.T - kernel).max() < 0.1


def test_statistics_are_finite():
    for text in ("", " ", "x", "\n" * 50, "é" * 5000, "a|b " * 9):
        assert np.isfinite(qc.statistics(text)).all() and len(qc.statistics(text)) == qc.N_STATISTICS


def test_scoring_a_batch_keeps_to_the_memory_of_a_block():
    rng = np.random.default_rng(qc.SEED)
    d, m = qc.N_STATISTICS, qc.FEATURES
    model = qc.Model(np.zeros(d), np.ones(d), rng.normal(size=(d, m)), rng.normal(size=m), rng.normal(size=m + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    f = rng.normal(size=(20_001, d))
    tracemalloc.start()
    raw = model.raw(f)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(raw, model.features(f) @ model.weights) and most < 10e6
    assert model.raw(f[:0]).shape == (0,)
    common.kept_in_worker("of another operator", lambda: f)
    assert len(qc.scores_of(model, pd.Series(["a b", ""]))) == 2 and not common._KEPT
