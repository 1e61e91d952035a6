"""Exact top-k inner-product search: ball trees per shard, branch and bound.

Vectors are dealt into balls by the upper levels of a ball tree, which is
fitted on a bounded sample; every vector is in one. A ball of many vectors is
several shards, each with a ball tree of its own that is built once and
stored. A query is answered first in a shard of the ball with the highest
upper bound ``q.c + |q| r``; the k-th score found there is its floor, and the
query goes on only to the shards of balls whose bound reaches it. In a shard,
the nodes of the tree are opened in the order of their bound, from the root
on; a node's children are bounded only if it is opened, only for the queries
whose current k-th score its bound reaches, and each leaf raises those scores.
Queries travel in blocks, so that a task holds one shard and one block.

Defined results: vectors that are null, or hold null, NaN or infinite
components, and rows without an id take no part; vectors of unequal length
have no score; equal rows are separate candidates of each other, and each row
that is a query has its own result rows; ties go to the smaller id, and equal
ids of equal score may swap; an empty table gives no rows; a score beyond 64
bits is clamped to the nearest long; further columns are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm.common import parallel, written

#: Vectors in a shard, queries in a block, vectors in a leaf.
SHARD, BLOCK, LEAF = 8192, 1024, 128
#: Rows that the balls are fitted on, and balls, at most.
SAMPLE, BALLS = 16_384, 2048
FOUND = "query_row long, query_id long, vec_id long, score long"
ASKED = "vec_id long, v array<double>, row long, floor long, shard long"


class BallTree:
    """A binary tree of balls over the rows of a matrix, stored level by level."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple[int, int, int]] = []  # first, last, left child (right: one more), -1: leaf
        self.centers, self.radii = [], []
        self._add(vectors, 0, len(vectors))
        at = 0
        while at < len(self.nodes):
            first, last, _ = self.nodes[at]
            if last - first > leaf:
                rows = self.order[first:last]
                part = vectors[rows]
                axis = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if part.shape[1] else 0
                half = (last - first) // 2
                if part.shape[1]:
                    self.order[first:last] = rows[np.argpartition(part[:, axis], half)]
                self.nodes[at] = (first, last, len(self.nodes))
                self._add(vectors, first, first + half)
                self._add(vectors, first + half, last)
            at += 1
        self.center, self.radius = np.array(self.centers), np.array(self.radii)

    def _add(self, vectors: np.ndarray, first: int, last: int) -> None:
        part = vectors[self.order[first:last]]
        center = part.mean(axis=0)
        self.centers.append(center)
        self.radii.append(float(np.sqrt(((part - center) ** 2).sum(axis=1).max())) if len(part) else 0.0)
        self.nodes.append((first, last, -1))


def exact_matrix(vectors: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as float64 if products are exact there, else as whole Python numbers."""
    top = max((np.abs(x).max() if x.size else 0.0) for x in (vectors, others))
    if vectors.shape[1] * top * top < 2.0**53:
        return vectors, others
    whole = np.vectorize(int, otypes=[object])
    return whole(vectors) if vectors.size else vectors, whole(others) if others.size else others


def search_shard(tree: BallTree, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, q_rows: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of each query's k best in the shard that reach its floor.

    ids, rows: id and row number of each vector; q_rows: the queries' own row
    numbers, which are no candidates; floor: scores that are known to be
    reached k times elsewhere. Ties at the k-th place go to the smaller id.
    """
    exact_v, exact_q = exact_matrix(vectors, queries)
    norms = np.sqrt((queries**2).sum(axis=1))
    slack = 1e-9 * (1 + norms * (np.abs(vectors).max() if vectors.size else 0) * max(1, vectors.shape[1]))
    kth = floor.astype(float)
    bounds = lambda n, who: queries[who] @ tree.center[n] + norms[who] * tree.radius[n] + slack[who]
    pool_q, pool_i, pool_s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, exact_v.dtype if exact_v.dtype == object else np.float64)
    every = np.arange(len(queries))
    own = bounds(0, every)
    heap = [(-own.max(), 0, every, own)] if len(every) else []
    while heap:
        _, n, who, bound = heappop(heap)
        active = ~(bound < kth[who])
        who, bound = who[active], bound[active]
        if not len(who):
            continue
        left = tree.nodes[n][2]
        if left >= 0:
            for child in (left, left + 1):
                # A node lies in its parent, so the parent's bound holds for it as well.
                b = np.minimum(bound, bounds(child, who))
                reach = ~(b < kth[who])
                if reach.any():
                    heappush(heap, (-b[reach].max(), child, who[reach], b[reach]))
            continue
        members = tree.order[tree.nodes[n][0] : tree.nodes[n][1]]
        scores = exact_q[who] @ exact_v[members].T
        hit_q, hit_v = np.nonzero((scores >= kth[who][:, None]) & (rows[members][None, :] != q_rows[who][:, None]))
        pool_q = np.concatenate([pool_q, who[hit_q]])
        pool_i = np.concatenate([pool_i, ids[members[hit_v]]])
        pool_s = np.concatenate([pool_s, scores[hit_q, hit_v]])
        order = np.lexsort((pool_i, -pool_s, pool_q))
        pool_q, pool_i, pool_s = pool_q[order], pool_i[order], pool_s[order]
        starts = np.searchsorted(pool_q, np.arange(len(queries) + 1))
        keep = np.arange(len(pool_q)) - starts[pool_q] < k
        full = np.flatnonzero(np.diff(starts) >= k)
        kth[full] = np.maximum(kth[full], pool_s[starts[full] + k - 1].astype(float))
        pool_q, pool_i, pool_s = pool_q[keep], pool_i[keep], pool_s[keep]
    return pool_q, pool_i, pool_s


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), dtype=np.float64).reshape(len(v), len(v.iloc[0]) if len(v) else 0)


def _built(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard as one value: ids, row numbers, vectors and their tree."""
    pdf = pdf.sort_values("row")
    vectors = _matrix(pdf["v"])
    data = pickle.dumps((pdf["vec_id"].to_numpy(), pdf["row"].to_numpy(), vectors, BallTree(vectors)))
    return pd.DataFrame({"shard": pdf["shard"][:1], "tree": [data]})


def _answer(shard: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(shard) or not len(asked):
        return pd.DataFrame({c.split()[0]: np.empty(0, np.int64) for c in FOUND.split(", ")})
    ids, rows, vectors, tree = pickle.loads(shard["tree"].iloc[0])
    floor = asked["floor"].astype(float).fillna(-np.inf).to_numpy()
    q, i, s = search_shard(tree, ids, rows, vectors, asked["row"].to_numpy(), _matrix(asked["v"]), floor, k)
    score = [max(-(2**63), min(2**63 - 1, int(x))) for x in s]
    return pd.DataFrame({"query_row": asked["row"].to_numpy()[q], "query_id": asked["vec_id"].to_numpy()[q], "vec_id": i, "score": np.array(score, np.int64)})


def prepared(spark: SparkSession, vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, v (whole components as double), row (a number of each row)."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).where(sound)
    whole = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**44, F.floor(c * scale).cast("double")).otherwise(c * scale))
    return written(spark, kept.select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"), F.monotonically_increasing_id().alias("row")), "vectors")


class Balls:
    """The upper levels of a ball tree: for each length of vectors, the balls that they are dealt into."""

    def __init__(self, sample: list[list[float]], balls: int) -> None:
        self.centers: dict[int, np.ndarray] = {}
        for dim in {len(v) for v in sample} - {0}:
            part = np.array([v for v in sample if len(v) == dim], np.float64).reshape(-1, dim)
            tree = BallTree(part, max(1, -(-len(part) // balls)))
            self.centers[dim] = tree.center[[n for n, x in enumerate(tree.nodes) if x[2] < 0]]

    def nearest(self, dim: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ball, distance to its centre) of each vector."""
        if dim not in self.centers:
            return np.zeros(len(vectors), np.int64), np.sqrt((vectors**2).sum(axis=1))
        centers = self.centers[dim]
        # |v - c|^2 up to |v|^2, which is the same for all centres
        at = (np.square(centers).sum(axis=1)[None, :] - 2 * vectors @ centers.T).argmin(axis=1)
        return at.astype(np.int64), np.sqrt(((vectors - centers[at]) ** 2).sum(axis=1))

    def center(self, dim: int, ball: int) -> np.ndarray:
        return self.centers[dim][ball] if dim in self.centers else np.zeros(dim)


def dealt(spark: SparkSession, vectors: DataFrame, shard_rows: int, sample: int, balls: int) -> tuple[DataFrame, Balls, list[dict]]:
    """(vectors with their shard, the balls, for each ball that has vectors: dim, ball, radius, first shard, shards)."""
    total = vectors.count()
    fitted = vectors.orderBy(F.xxhash64("row")).limit(sample).select("v")
    model = Balls([r["v"] for r in fitted.collect()], min(balls, max(1, -(-total // shard_rows))))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            lengths = pdf["v"].map(len)
            for dim in lengths.unique():
                part = pdf[lengths == dim]
                ball, far = model.nearest(int(dim), _matrix(part["v"]))
                yield part.assign(dim=int(dim), ball=ball, far=far)

    placed = written(spark, vectors.mapInPandas(deal, "vec_id long, v array<double>, row long, dim int, ball long, far double"), "topk-balls")
    held = placed.groupBy("dim", "ball").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).orderBy("dim", "ball").collect()  # BALLS rows a length
    info, first = [], 0
    for r in held:
        shards = -(-r["n"] // shard_rows)
        info.append({"dim": r["dim"], "ball": r["ball"], "radius": r["radius"] * (1 + 1e-9), "first": first, "shards": shards})
        first += shards
    table = spark.createDataFrame([(b["dim"], b["ball"], b["first"], b["shards"]) for b in info], "dim int, ball long, first long, shards long")
    shard = F.col("first") + F.pmod(F.xxhash64("row"), F.col("shards"))
    return placed.join(F.broadcast(table), ["dim", "ball"]).select("vec_id", "v", "row", shard.alias("shard")), model, info


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD, block_rows: int = BLOCK, sample: int = SAMPLE, balls: int = BALLS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best among all vectors but itself.

    ``vectors`` and ``queries`` come from prepared(); queries are some of the
    vectors. A query and a shard meet only if the bound of the shard's ball
    reaches the query's k-th score.
    """
    if vectors.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards, model, info = dealt(spark, vectors, shard_rows, sample, balls)
    trees = written(spark, shards.groupBy("shard").applyInPandas(_built, "shard long, tree binary"), "topk-trees")
    groups = {dim: [b for b in info if b["dim"] == dim] for dim in {b["dim"] for b in info}}
    center = {dim: np.array([model.center(dim, b["ball"]) for b in own]).reshape(len(own), dim) for dim, own in groups.items()}
    radius, first, number = ({dim: np.array([b[c] for b in own]) for dim, own in groups.items()} for c in ("radius", "first", "shards"))
    # Fresh columns: queries and vectors come from the same table.
    asked = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns)).toDF(*queries.columns).select("vec_id", "v", "row")

    def reached(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query for the shards it goes to: without a floor one of the best ball, else all others that may reach it."""
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                v, dim = np.array(r.v, np.float64), len(r.v)
                if dim not in groups:
                    continue
                norm = np.sqrt(v @ v)
                bound = center[dim] @ v + norm * radius[dim]
                bound += 1e-9 * (1 + norm * (np.sqrt(np.square(center[dim]).sum(axis=1)) + radius[dim]))
                best = int(bound.argmax())
                home = int(first[dim][best] + r.row % number[dim][best])
                if r.home:
                    out.append((r.vec_id, r.v, r.row, None, home))
                else:
                    floor = None if pd.isna(r.floor) else int(r.floor)
                    for b in np.flatnonzero(~(bound < (-np.inf if floor is None else floor))):
                        out += [(r.vec_id, r.v, r.row, floor, s) for s in range(int(first[dim][b]), int(first[dim][b] + number[dim][b])) if s != home]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ASKED.split(", ")]).astype({"floor": "Int64"})

    tasks = parallel(spark)
    block = F.pmod(F.xxhash64(F.col("row"), F.lit(1)), F.ceil(F.col("n") / block_rows)).cast("int")

    def found(pairs: DataFrame) -> DataFrame:
        """The answers of shards to the queries that came to them, in blocks."""
        sizes = pairs.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        asked_for = sizes.withColumn("block", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block_rows) - 1).cast("int"))))
        held = trees.join(asked_for.select("shard", "block"), "shard")
        blocks = pairs.join(sizes, "shard").withColumn("block", block).drop("n")
        return held.groupBy("shard", "block").cogroup(blocks.groupBy("shard", "block")).applyInPandas(lambda a, b: _answer(a, b, k), FOUND)

    none = asked.withColumn("floor", F.lit(None).cast("long"))
    start = written(spark, found(written(spark, none.withColumn("home", F.lit(True)).repartition(tasks).mapInPandas(reached, ASKED), "topk-first")), "topk-home")
    # The k-th score at home is a floor everywhere: k candidates reach it.
    kth = start.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    away = asked.join(kth, asked["row"] == kth["query_row"], "left").select("vec_id", "v", "row", "floor", F.lit(False).alias("home"))
    rest = written(spark, away.mapInPandas(reached, ASKED), "topk-pairs")
    merged = start.unionByName(found(rest))
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    ranked = merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
