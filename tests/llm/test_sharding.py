import random
import zlib

import pytest
from pyspark.sql import functions as F

from tracelake.llm import sharding


def fits(sizes, capacity, shards):
    used, room = 0, 0
    for s in sizes:
        if s > capacity:
            return False
        if s > room:
            used, room = used + 1, capacity
        room -= s
    return used <= shards


def smallest_capacity(sizes, shards):
    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(sizes, c, shards))


@pytest.mark.parametrize("seed,shards,hot", [(1, 8, 0), (2, 3, 0), (3, 8, 4000), (4, 5, 900), (5, 1, 0)])
def test_capacity_is_minimal_and_cuts_keep_to_it(spark, seed, shards, hot):
    rng = random.Random(seed)
    groups = sorted((rng.randrange(-(2**63), 2**63), rng.randrange(1, 60)) for _ in range(300))
    if hot:
        groups[100] = (groups[100][0], hot)
    sizes = [s for _, s in groups]
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(groups, "group_hash long, bytes long"), shards)
    assert capacity == smallest_capacity(sizes, shards)
    totals = [0] * shards
    for h, s in groups:
        totals[sum(h >= c for c in cuts)] += s
    assert max(totals) <= capacity
    if not hot:
        assert max(totals) - min(totals) <= 2 * max(sizes) * shards


def test_hash_neighbours_are_told_apart(spark):
    groups = [(i, 1 + i % 3) for i in range(50)] + [(2**62 + i, 5) for i in range(50)]
    sizes = [s for _, s in groups]
    capacity, _ = sharding.minimax_cuts(spark.createDataFrame(groups, "group_hash long, bytes long"), 7)
    assert capacity == smallest_capacity(sizes, 7)


@pytest.mark.parametrize("share", [0.3, 0.6])
def test_one_dominant_group_among_many(spark, share):
    rng = random.Random(11)
    groups = [(rng.randrange(-(2**63), 2**63), rng.randrange(20, 400)) for _ in range(20_000)]
    rest = sum(s for _, s in groups)
    big = round(rest * share / (1 - share))
    groups = sorted([*groups, (rng.randrange(-(2**63), 2**63), big)])
    table = spark.createDataFrame(groups, "group_hash long, bytes long").cache()
    capacity, cuts, ranges = sharding.search(table, 8)
    assert fits([s for _, s in groups], capacity, 8) and (capacity == big or not fits([s for _, s in groups], capacity - 1, 8))
    assert ranges.most <= sharding.SPLIT * 8 * 2**sharding.BITS
    cuts, alone = sharding.cut(table, 8)
    assert alone == [h for h, s in groups if s == big]
    totals = [0] * 8
    for h, s in groups:
        totals[0 if s == big else 1 + sum(h >= c for c in cuts)] += s
    assert totals[0] == big and max(totals[1:]) - min(totals[1:]) <= 16 * 400


def test_ranges_that_the_driver_holds_are_bounded(spark):
    rng = random.Random(12)
    groups = sorted((rng.randrange(-(2**63), 2**63), 5000 if i % 4000 == 0 else rng.randrange(1, 90)) for i in range(30_000))
    capacity, _, ranges = sharding.search(spark.createDataFrame(groups, "group_hash long, bytes long").cache(), 6)
    sizes = [s for _, s in groups]
    assert fits(sizes, capacity, 6) and not fits(sizes, capacity - 1, 6)
    assert ranges.most <= sharding.SPLIT * 6 * 2**sharding.BITS


def test_contract(spark, docs, rows):
    got = sharding.shard_documents(spark, docs, 8).toPandas()
    want = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted(map(tuple, got[["doc_id", "size", "text_crc32"]].fillna(-1).astype(int).to_numpy().tolist())) == want
    assert got.groupby("group_hash")["shard"].nunique().max() == 1
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert got["shard"].between(0, 7).all()


def test_empty_table_and_few_rows(spark, empty, docs):
    assert sharding.shard_documents(spark, empty).count() == 0
    assert sharding.shard_documents(spark, docs.limit(1)).count() == 1


def test_write_shards_keeps_rows(spark, docs, tmp_path):
    _, cuts = sharding.minimax_cuts(sharding.sized(docs).groupBy("group_hash").agg(F.sum("size").alias("bytes")), 3)
    sharding.write_shards(docs.drop("shard"), cuts, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == docs.count() and back.select("shard").distinct().count() <= 3


def test_ranks_are_gapless_prefix_sums(spark):
    from tracelake.llm.common import rank_in_groups

    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id"))
    got = rank_in_groups(df, ["k"], F.xxhash64("id"), [F.col("id")], "r").toPandas()
    for _, part in got.groupby("k"):
        assert sorted(part["r"]) == list(range(len(part)))
