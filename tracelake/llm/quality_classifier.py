"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of each text (shares of symbols, upper case, repeated words and
the like) are standardised and lifted by random Fourier features, which
approximate a Gaussian kernel. Every partition sums its normal equations
(the features' Gram matrix and their products with the labels); the sums are
added and solved once. Raw scores of a fold that the fit has not seen are
calibrated by pool-adjacent-violators over score bins.

Learned from at most LABELLED rows (those with the smallest hashes), which
the caller may change: their statistics are computed first, then all documents
are scored in one pass over the texts.

Defined results: a null text is scored as an empty one; rows without an id
are held out of learning and are scored; a document with several labels
counts once for each; labels that are null don't count; with no usable label
at all every score is 0.5; further columns are left out; equal texts have
equal scores and repeated rows are scored each, ties need no rule; statistics
are those of whole texts, however long; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import forget_kept, written

#: Labelled rows that are learned from at most.
LABELLED = 50_000
FEATURES, RIDGE, SEED, BINS = 256, 1.0, 7, 512
THRESHOLD = 0.3
BLOCK = 32  # rows of the normal equations that are summed in one group
AT_ONCE = 512  # texts of which features are made at once: a text's take 2 KB, and as much for each intermediate array

_CLASS = np.zeros(256, np.int64)  # 1 space, 2 digit, 3 upper, 4 lower, 5 full stop, 6 other sign, 0 rest
_CLASS[[0x20, *range(0x09, 0x0E)]] = 1
_CLASS[list(b"0123456789")] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[list(b".,;:!?'\"()-")] = 5
_CLASS[list(b"#*$%&|<>[]{}@^~_=+/\\`")] = 6
N_STATISTICS = 20


def statistics(text: str) -> list[float]:
    """Twenty statistics of a text, all finite; the empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * N_STATISTICS
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) / len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    low = raw.lower().split()
    counts = Counter(low)
    pairs = set(zip(low, low[1:], strict=False))
    n = len(words)
    ends = Counter(w[-1] for w in words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    bangs = raw.count(b"!!")
    return [
        np.log1p(n), np.log1p(len(lines)), float(lengths.mean()), float(lengths.std()),
        kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[0],
        len(counts) / n, max(counts.values()) / n, len(pairs) / max(1, n - 1), len(set(lines)) / len(lines),
        sum(ends[c] for c in b"#*$%&|<>") / n, words.count(b"|") / n, bangs / n,
        sum(w.isupper() for w in words) / n, ends[ord(".")] / n, float((lengths > 20).mean()),
    ]


def labelled(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, limit: int) -> DataFrame:
    """f (statistics), y, fold of the rows that are learned from. Ids of ``limit`` labels at most go to the documents."""
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    known = known.withColumn("fold", fold("doc_id")).where("fold <> 0")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(limit)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_kept()
        for pdf in frames:
            yield pd.DataFrame({"y": pdf["y"], "fold": pdf["fold"], "f": [statistics(t) for t in pdf["text"].array]})

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.join(F.broadcast(known), "doc_id").select("text", "y", "fold").mapInPandas(batches, "y double, fold long, f array<double>")


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out of learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(0))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, f: np.ndarray) -> np.ndarray:
        x = np.clip((f - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2.0 / len(self.phase)) * np.cos(x @ self.omega + self.phase)
        return np.hstack([z, np.ones((len(f), 1))])

    def blocks(self, f: np.ndarray) -> Iterator[np.ndarray]:
        """The features of AT_ONCE rows after the other, so that memory doesn't grow with the batch."""
        for at in range(0, len(f), AT_ONCE):
            yield self.features(f[at : at + AT_ONCE])

    def raw(self, f: np.ndarray) -> np.ndarray:
        return np.concatenate([np.empty(0), *(z @ self.weights for z in self.blocks(f))])

    def score(self, f: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of the raw score keeps the order within a step."""
        raw = self.raw(f)
        steps = np.interp(raw, self.knots, self.values) if len(self.knots) else np.full(len(raw), 0.5)
        return 0.999 * steps + 0.001 / (1 + np.exp(-4 * (raw - 0.5))) if len(self.knots) else steps


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (centre of each pool, its mean), both ascending."""
    pools: list[list[float]] = []
    for xi, yi, wi in sorted(zip(x.tolist(), y.tolist(), w.tolist(), strict=True)):
        pools.append([xi * wi, yi * wi, wi])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", limit: int = LABELLED) -> Model:
    """Folds 1 to 3 fit the scores, fold 4 calibrates them, fold 0 is left out."""
    rows = written(spark, labelled(docs, labels, text, doc_id, label, limit), "classifier-labelled")
    rng = np.random.default_rng(SEED)
    empty = Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), rng.normal(size=(N_STATISTICS, FEATURES)) / np.sqrt(N_STATISTICS), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.empty(0), np.empty(0))
    train, held = rows.where("fold < 4"), rows.where("fold = 4")
    moments = train.agg(*[g for i in range(N_STATISTICS) for g in (F.avg(F.col("f")[i]), F.stddev_pop(F.col("f")[i]))]).first()
    if moments[0] is None:
        return empty
    mean, scale = np.array(moments[0::2], float), np.array(moments[1::2], float)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), empty.omega, empty.phase, empty.weights, empty.knots, empty.values)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for pdf in frames:
            if len(pdf):
                y = pdf["y"].to_numpy()
                for i, z in enumerate(model.blocks(np.vstack(pdf["f"].to_numpy()))):
                    total += z.T @ np.column_stack([z, y[AT_ONCE * i :][:AT_ONCE]])
        blocks = range(0, FEATURES + 1, BLOCK)
        yield pd.DataFrame({"block": list(blocks), "sums": [total[b : b + BLOCK].tobytes() for b in blocks]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b) for b in pdf["sums"]], axis=0)
        return pd.DataFrame({"block": pdf["block"][:1], "sums": [total.tobytes()]})

    sums = train.select("f", "y").mapInPandas(partial, "block int, sums binary").groupBy("block").applyInPandas(added, "block int, sums binary")
    parts = [bytes(r["sums"]) for r in sorted(sums.collect(), key=lambda r: r["block"])]  # the model's size, whatever the corpus
    normal = np.frombuffer(b"".join(parts)).reshape(FEATURES + 1, FEATURES + 2)
    model.weights = np.linalg.solve(normal[:, :-1] + RIDGE * np.eye(FEATURES + 1), normal[:, -1])

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            raw = model.raw(np.vstack(pdf["f"].to_numpy())) if len(pdf) else np.empty(0)
            yield pd.DataFrame({"bin": np.clip(np.floor((raw + 1) / 3 * BINS), 0, BINS - 1).astype(int), "raw": raw, "y": pdf["y"]})

    bins = held.select("f", "y").mapInPandas(binned, "bin int, raw double, y double").groupBy("bin")
    found = bins.agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).toPandas()  # BINS rows at most
    if len(found):
        model.knots, model.values = isotonic(*(found[c].to_numpy(float) for c in "xyn"))
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scores_of(model: Model, texts: pd.Series) -> pd.Series:
    forget_kept()
    return pd.Series(np.clip(model.score(np.array([statistics(t) for t in texts.array]).reshape(len(texts), N_STATISTICS)), 0, 1))


def scores(model: Model) -> Callable[[Column], Column]:
    """The score of a text column, nulls as empty texts."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return scores_of(model, texts)

    return lambda text: score(F.coalesce(text, F.lit("")))


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", threshold: float = THRESHOLD, limit: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(spark, docs, labels, text, doc_id, label, limit)
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), scores(model)(F.col(text)).alias("score"))
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", threshold: float = THRESHOLD, limit: int = LABELLED) -> DataFrame:
    """``docs`` without those scored below the threshold, all their columns."""
    model = fit(spark, docs, labels, text, doc_id, label, limit)
    return docs.where(scores(model)(F.col(text)) >= threshold)
