"""Hard negatives by exact integer scores: a residue number system and blocks.

Rows are sorted by vector length and label and cut into blocks of a bounded
number of components; anchors likewise. Each pair of blocks that can hold a
positive (labels overlap) or a negative (not both of one label) is scored by
one task, and only such pairs. Components are whole numbers, and so are
scores: the matrices are reduced modulo small primes and multiplied in
float32, where sums stay below 2**24 and so are exact; slabs of the inner
dimension keep them so for vectors of any length. As many primes are taken as
the largest possible score of the pair of blocks needs, and Chinese
remaindering (by mixed radix) gives back exact signed scores.

The first join gives each anchor its positives, the best rows of its label;
the second selects, within the window that each positive's score sets, the
best rows of other labels. Blocks return a bounded number of rows for each
anchor and positive, which are merged by rank.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part; a row is no candidate of itself, equal
rows with equal ids are candidates of each other, and equal ids of equal score
may swap; ties go to the smaller id; vectors of unequal length have no score
(vectors of length 0 score 0 with their like); anchors without positives or
negatives have no rows; a score beyond 64 bits is the nearest long, and is
compared as such; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm.common import written

#: Rows of a block of candidates and of anchors; components of either; anchors scored at a time.
BLOCK, ANCHORS, COMPONENTS, SLICE = 8192, 2048, 1 << 21, 64
#: Below it whole numbers are exact in float32.
EXACT = 1 << 24
#: Primes below 256, largest first: a centred residue is at most 125.
PRIMES = [p for p in range(255, 2, -1) if all(p % d for d in range(2, 16) if d < p)]
LONG = (1 << 63) - 1
BLOCKS = "dim int, low long, high long, data binary"
FOUND = "anchor_row long, anchor_id long, place int, positive_id long, positive_score long, vec_id long, score long"
POSITIVES = "array<struct<place: int, vec_id: bigint, score: bigint>>"


def residues(whole: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers in float64 modulo p, centred, as float32."""
    r = np.fmod(whole, p)
    return (r - p * np.rint(r / p)).astype(np.float32)


def modular_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, from 0 to p - 1; no sum reaches EXACT."""
    slab = max(1, (EXACT - 1) // (p // 2) ** 2)
    total = np.zeros((len(a), len(b)), np.int64)
    for first in range(0, a.shape[1], slab):
        total += (a[:, first : first + slab] @ b[:, first : first + slab].T).astype(np.int64)
    return total % p


def primes_for(bound: int) -> list[int]:
    """Primes whose product is over 2 * bound; further ones follow if those below 256 don't do."""
    out, product, p = [], 1, 255
    while product <= 2 * bound:
        if len(out) < len(PRIMES):
            out.append(PRIMES[len(out)])
        else:
            p += 2
            while any(p % d == 0 for d in range(3, int(p**0.5) + 1, 2)):
                p += 2
            out.append(p)
        product *= out[-1]
    return out


class Scorer:
    """Exact scores against a block of candidates, whose residues are kept."""

    def __init__(self, candidates: np.ndarray, top: int) -> None:
        """top: the largest absolute component of what will be scored against them."""
        self.n = len(candidates)
        bound = candidates.shape[1] * top * (int(np.abs(candidates).max()) if candidates.size else 0)
        self.primes = primes_for(bound)
        self.parts = [residues(candidates, p) for p in self.primes]
        self.kind = np.int64 if 1024 * bound < LONG else object

    def scores(self, a: np.ndarray) -> np.ndarray:
        """a @ candidates.T as int64, clamped."""
        score, weight, digits = np.zeros((len(a), self.n), self.kind), 1, []
        for p, part in zip(self.primes, self.parts, strict=True):
            r = modular_product(residues(a, p), part, p)
            # The digit of p in mixed radix: what the digits before leave of the residue.
            scale = 1
            for q, digit in digits:
                r -= digit * scale
                scale = scale * q % p
            r = r * pow(scale, -1, p) % p
            digits.append((p, r))
            score += r.astype(self.kind) * weight
            weight *= p
        score = np.where(score > weight // 2, score - weight, score)
        return score if self.kind is np.int64 else np.clip(score, -LONG - 1, LONG).astype(np.int64)


def sound(spark: SparkSession, vectors: DataFrame, label: str | Column = "label", vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label, v (whole components as double), row (a number of each row) of the rows that take part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    label = (F.col(label) if isinstance(label, str) else label).cast("long")
    kept = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & label.isNotNull()).where(finite)
    # From 2**44 on a double times scale is whole; what overflows is the largest double.
    most = F.lit(float(np.finfo(np.float64).max))
    whole = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**44, F.floor(c * scale).cast("double")).otherwise(F.greatest(-most, F.least(most, c * scale))))
    return written(spark, kept.select(F.col(vec_id).cast("long").alias("vec_id"), label.alias("label"), whole.alias("v"), F.monotonically_increasing_id().alias("row")), "sound-vectors")


def blocks(spark: SparkSession, rows: DataFrame, size: int, name: str) -> DataFrame:
    """block, dim, low, high (labels), data of blocks of ``size`` rows at most, cut from ranges sorted by (dim, label)."""
    columns = [c for c in ("vec_id", "row", "label", "positives") if c in rows.columns]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        dim = 0

        def block() -> pd.DataFrame:
            matrix = np.array(held["v"], np.float64).reshape(len(held["v"]), dim)
            small = next((t for t in (np.int16, np.int32) if not matrix.size or np.abs(matrix).max() <= np.iinfo(t).max), np.float64)
            data = pickle.dumps((matrix.astype(small), {c: held[c] if c == "positives" else np.array(held[c], np.int64) for c in columns}))
            out = pd.DataFrame({"dim": [dim], "low": [min(held["label"])], "high": [max(held["label"])], "data": [data]})
            held.clear()
            return out

        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if held and (r.dim != dim or len(held["v"]) >= size or len(held["v"]) * dim >= COMPONENTS):
                    yield block()
                dim = r.dim
                for c in ("v", *columns):
                    x = getattr(r, c)
                    held.setdefault(c, []).append([(int(p["place"]), int(p["vec_id"]), int(p["score"])) for p in x] if c == "positives" else x)
        if held:
            yield block()

    order = ["dim", "label", "row"]
    n = max(1, -(-rows.count() // size))
    ranges = rows.withColumn("dim", F.size("v")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(spark, ranges.mapInPandas(cut, BLOCKS).withColumn("block", F.monotonically_increasing_id()), name)


def _positives(a: dict, c: dict, scores: np.ndarray, i: int, k: int) -> list[tuple]:
    """An anchor's k best rows of its label in a block."""
    own = np.flatnonzero((c["label"] == a["label"][i]) & (c["row"] != a["row"][i]))
    best = own[np.lexsort((c["vec_id"][own], -scores[own]))[:k]]
    return [(a["row"][i], a["vec_id"][i], 0, 0, 0, c["vec_id"][j], scores[j]) for j in best]


def _negatives(a: dict, c: dict, scores: np.ndarray, i: int, k: int, low: int, high: int) -> list[tuple]:
    """For each of an anchor's positives, the k best rows of other labels in its window."""
    out, other = [], c["label"] != a["label"][i]
    for place, positive, score in a["positives"][i]:
        own = np.flatnonzero(other & (scores >= -(-low * score // 100)) & (scores <= high * score // 100))
        best = own[np.lexsort((c["vec_id"][own], -scores[own]))[:k]]
        out += [(a["row"][i], a["vec_id"][i], place, positive, score, c["vec_id"][j], scores[j]) for j in best]
    return out


def _met(spark: SparkSession, anchors: DataFrame, candidates: DataFrame, slots: int, meet: Column, k: int, select: Callable[..., list[tuple]]) -> DataFrame:
    """For each anchor and place, the k best of what ``select`` gives over the scores of each block that ``meet`` joins with the anchor's.

    Blocks of candidates are dealt into ``slots``; a task has one slot and one
    block of anchors, scores block after block and keeps the best.
    """
    columns = [f.split()[0] for f in FOUND.split(", ")]

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            x, a = pickle.loads(right["data"].iloc[0])
            x = x.astype(np.float64)
            for data in left["data"]:
                y, c = pickle.loads(data)
                scorer = Scorer(y.astype(np.float64), int(np.abs(x).max()) if x.size else 0)
                for first in range(0, len(x), SLICE):
                    scores = scorer.scores(x[first : first + SLICE])
                    for i in range(len(scores)):
                        out += select(a, c, scores[i], first + i)
        found = pd.DataFrame(out, columns=columns)
        return found.sort_values(["score", "vec_id"], ascending=[False, True]).groupby(["anchor_row", "place"]).head(k) if len(left) > 1 else found

    # Only numbers of blocks are joined here, slot by slot, so that no task makes all pairs.
    slot = F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot")
    a = anchors.select(F.col("block").alias("a"), "dim", F.col("low").alias("a_low"), F.col("high").alias("a_high"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    c = candidates.select(F.col("block").alias("c"), "dim", F.col("low").alias("c_low"), F.col("high").alias("c_high"), slot)
    pairs = written(spark, a.join(c, ["dim", "slot"]).where(meet).select("a", "slot", "c"), "block-pairs")
    left = pairs.join(candidates.select(F.col("block").alias("c"), "data"), "c").groupBy("a", "slot")
    # Fresh columns: both sides come from the same pairs.
    met = pairs.select(F.col("a").alias("_a"), F.col("slot").alias("_slot")).distinct().toDF("a", "slot")
    right = met.join(anchors.select(F.col("block").alias("a"), "data"), "a").groupBy("a", "slot")
    return left.cogroup(right).applyInPandas(scored, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor_row", "place").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(spark: SparkSession, rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows come from sound(). An anchor's positives are its best rows of its own
    label; a positive's negatives are the best rows of other labels with a
    score from ``low`` to ``high`` percent of the positive's.
    """
    candidates = blocks(spark, rows, BLOCK, "candidate-blocks")
    # Fresh columns: anchors and candidates come from the same table.
    anchors = rows.where(is_anchor).select(*(F.col(c).alias(f"_{c}") for c in rows.columns)).toDF(*rows.columns)
    slots = max(1, -(-rows.count() // BLOCK))
    overlap = (F.col("a_low") <= F.col("c_high")) & (F.col("c_low") <= F.col("a_high"))
    found = _met(spark, blocks(spark, anchors, ANCHORS, "anchor-blocks"), candidates, slots, overlap, positives, lambda a, c, s, i: _positives(a, c, s, i, positives))
    own = _ranked(found, positives).groupBy(F.col("anchor_row").alias("row")).agg(F.collect_list(F.struct(F.col("rank").alias("place"), "vec_id", "score")).cast(POSITIVES).alias("positives"))
    with_positives = written(spark, anchors.join(own, "row"), "anchors")
    differ = ~((F.col("a_low") == F.col("a_high")) & (F.col("c_low") == F.col("c_high")) & (F.col("a_low") == F.col("c_low")))
    found = _met(spark, blocks(spark, with_positives, ANCHORS, "anchor-blocks"), candidates, slots, differ, negatives, lambda a, c, s, i: _negatives(a, c, s, i, negatives, low, high))
    return _ranked(found, negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
