"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a budget of words. Whole repeats of the source come first;
what is left of the budget is spent on a subset of its documents. Documents
are counted by exact length, every length gives its proportional share, and a
bounded knapsack over exact lengths decides what remains together with a few
documents set aside from the shares, whose choice it prefers. While the budget
isn't met that window doubles, until it holds all that the best sum can need;
so documents of all lengths are taken alike, and no set of lengths is given
up. The chosen number of documents of each length is taken
in seeded order. Only counts by (source, length) reach the knapsack, one
source a task.

Defined results: a null text has size 0; a null source is a source of its
own, ordered last; empty documents take part and add nothing; repeated rows
count each; documents of one source and length are taken in the order of a
seeded hash of id and text, then of the id (null first), and rows equal in
all of these may stand for each other; a null id is taken like any other; an
empty table gives no rows; further columns are left out; a source whose
target is 0 takes nothing; texts of any length are counted whole, and of a
source of a few very long ones the largest sum within the budget is taken.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm.common import rank_in_groups, shuffle_partitions, written

WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST = 3
#: Words of the knapsack's first window.
KNAPSACK = 65_536
#: Percent of a length's documents that may be taken beyond its share.
SPREAD = 8
#: Rows of a plan that are broadcast; a larger one is joined by shuffling.
BROADCAST = 1_000_000
PLAN = "key string, size long, n long, base long, extra long"


def bounded_knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length, so that their sum comes closest to budget from below.

    Counts are split into powers of two; reachable sums are the set bits of
    one integer, and every sum remembers the item that reached it first.
    """
    taken = [0] * len(lengths)
    reach, items, mask = 1, [], (1 << (budget + 1)) - 1
    by = np.full(budget + 1, -1, np.int32)
    for j, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        left, part = min(count, budget // length) if length else 0, 1
        while left > 0 and not reach >> budget & 1:
            n = min(part, left)
            new = (reach << (length * n)) & mask & ~reach
            if new:
                low = (new & -new).bit_length() - 1
                bits = np.unpackbits(np.frombuffer((new >> low).to_bytes((new.bit_length() - low + 7) // 8, "little"), np.uint8), bitorder="little")
                by[low + np.flatnonzero(bits)] = len(items)
                reach |= new
            items.append((j, n))
            left, part = left - n, part * 2
    at = reach.bit_length() - 1
    while at:
        j, n = items[by[at]]
        taken[j] += n
        at -= n * lengths[j]
    return taken


def even_shares(lengths: list[int], counts: list[int], budget: int) -> tuple[list[int], int]:
    """(documents of each length in proportion to their counts, what is left of the budget: less than the longest length that isn't taken whole).

    From the longest down, what whole documents leave of a length's share is
    carried to the next lengths, which take at most SPREAD more of their
    documents for it, so that a very long document that isn't taken is made up
    for by many lengths. What is left in the end is dealt again, in the same
    way without that limit, while it has room for the longest document left.
    """
    share, rest, spread = [0] * len(lengths), budget, SPREAD
    order = sorted(range(len(lengths)), key=lambda j: -lengths[j])
    while True:
        open_ = [j for j in order if 0 < lengths[j] <= rest and share[j] < counts[j]]
        total = sum(lengths[j] * (counts[j] - share[j]) for j in open_)
        goal, carry, taken, allowed = min(rest, total), 0, 0, 0
        for j in open_:
            free = counts[j] - share[j]
            carry += lengths[j] * free * goal  # in words times total
            allowed += free * (goal * 100 + spread * total)  # in documents times total times 100
            n = min(free, carry // (lengths[j] * total), max(0, (allowed + 50 * total) // (100 * total)) if spread else free)
            carry -= n * lengths[j] * total
            allowed -= n * 100 * total
            share[j], taken = share[j] + n, taken + n * lengths[j]
        rest -= taken
        if rest < max((lengths[j] for j in order if share[j] < counts[j]), default=0) or not (taken or spread):
            return share, rest
        spread = 0


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, knapsack: int = KNAPSACK) -> list[int]:
    """How many documents of each length to take once: the largest sum that is at most budget, close to even shares.

    What the shares leave is less than the longest length. The knapsack works
    on it and on some of the shares' own documents, set aside evenly over the
    lengths: these come first, then the others by how near their length is to
    what is left, so that a choice changes few words of the shares. Only while
    the sum misses, the window of what is set aside doubles.

    Ordered so that its running sum stays within the longest length, a
    difference between a best choice and the shares repeats a sum once it has
    twice as many documents as the longest has words, and what lies between can
    be left out. So some best choice differs by fewer; a window of that many
    documents of each length, or of all shares, needs no doubling.
    """
    ls, ns = [int(x) for x in lengths], [int(x) for x in counts]
    total = sum(x * n for x, n in zip(ls, ns, strict=True))
    if budget <= 0 or total == 0:
        return [0] * len(ls)
    if budget >= total:
        return ns
    unit = gcd(*(x for x, n in zip(ls, ns, strict=True) if n))
    ls, budget = [x // unit for x in ls], budget // unit
    share, rest = even_shares(ls, ns, budget)
    longest, kinds = max(ls), sum(x > 0 for x in ls)
    window = max(1, knapsack)
    held = [j for j in range(len(ls)) if share[j] and ls[j]]
    usual = sorted(x for x, n in zip(ls, ns, strict=True) if x and n)[kinds // 2]
    while True:
        aside = [min(n, window // (kinds * x)) if x else 0 for x, n in zip(ls, share, strict=True)]
        # One document each of lengths at even distances, as many as fit the window.
        spaced, step = window, max(1, sum(ls[j] for j in held) // window)
        for j in held[::step]:
            if not aside[j] and ls[j] <= spaced:
                aside[j], spaced = 1, spaced - ls[j]
        room = rest + sum(x * n for x, n in zip(ls, aside, strict=True))
        kept = [n - a for n, a in zip(share, aside, strict=True)]
        own = [j for j in held if aside[j]]
        new = sorted((j for j in range(len(ls)) if 0 < ls[j] <= room and share[j] < ns[j]), key=lambda j: abs(ls[j] - rest - usual))
        order = own + new
        more = bounded_knapsack([ls[j] for j in order], [aside[j] for j in own] + [ns[j] - share[j] for j in new], room)
        got = sum(ls[j] * m for j, m in zip(order, more, strict=True))
        if got == room or not any(kept[j] for j in held) or window >= 2 * kinds * longest**2:
            for j, m in zip(order, more, strict=True):
                kept[j] += m
            return kept
        window *= 2


def numbered(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """Adds ``number``: place by source, null last. Sources are range-sorted; parts are numbered one by one."""
    parts = shuffle_partitions(spark)
    ordered = sizes.repartitionByRange(parts, F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    ordered = written(spark, ordered, "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = ordered.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source"))
    return ordered.join(F.broadcast(offsets), "part").withColumn("number", F.col("before") + within - 1).drop("part", "before")


def targets(spark: SparkSession, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """key, source, source_size, target. ``sizes``: key, source, source_size.

    Shares of all words by weight, stopped at ``most`` times a source's size;
    the excess goes to the others by weight until nobody is above. The level
    (words a unit of weight) only rises, so a few sums over the sources find it.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    weighed = written(spark, numbered(spark, sizes).withColumn("weight", weight).drop("number"), "mix-weights")
    total, level, capped = None, None, -1
    full = F.col("source_size") * most
    while True:
        above = F.lit(False) if level is None else F.lit(level) * F.col("weight") > full
        whole, n, spent, open_ = weighed.agg(
            F.sum("source_size"), F.count(F.when(above, 1)), F.sum(F.when(above, full)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        total = total if total is not None else float(whole or 0)
        if n == capped or not open_:
            break
        capped, level = n, (total - float(spent or 0)) / open_
    return weighed.withColumn("target", F.least(F.lit(float(level or 0)) * F.col("weight"), full.cast("double")))


def planned(spark: SparkSession, docs: DataFrame, text: str, doc_id: str, source: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sizes and seeded hashes of all documents, what the mix takes of each source and length)."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), *keyed(text, doc_id, source, seed))
    slim = written(spark, slim, "mix-sizes")
    counts = written(spark, slim.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    sizes = counts.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = written(spark, targets(spark, sizes), "mix-targets")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        pdf = pdf.sort_values("size")
        base = min(MOST, int(target // whole)) if whole else 0
        extra = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), round(target - base * whole)) if base < MOST else 0
        return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "n": pdf["n"], "base": base, "extra": extra})

    # Dealt by number, so that the few counts of many sources aren't merged into one task.
    dealt = counts.select("key", "size", "n").join(goals.drop("source"), "key").repartition(shuffle_partitions(spark), "key")
    plans = dealt.groupBy("key").applyInPandas(plan, PLAN)
    return slim, written(spark, plans.join(goals.select("key", "source_size", "target"), "key"), "mix-plan")


def keyed(text: str, doc_id: str, source: str, seed: int) -> list[Column]:
    """size, key (of the source) and seeded hash of a document."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.when(F.col(source).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(source).cast("string")))
    return [size.alias("size"), key.alias("key"), F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("hash")]


def ranked(slim: DataFrame, plans: DataFrame) -> DataFrame:
    """Adds ``place``: a document's rank among those of its source and length."""
    return rank_in_groups(slim, ["key", "size"], F.col("hash"), [F.col("doc_id")], "place", extra=plans)


def mix(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 17) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, copies.

    ``copies`` says how often the mix takes the document, ``taken`` the words.
    """
    slim, plans = planned(spark, docs, text, doc_id, source, seed)
    copies = F.col("base") + (F.col("place") < F.col("extra")).cast("long")
    return ranked(slim, plans).select("doc_id", "size", "source", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed_documents(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 17, broadcast: int = BROADCAST) -> DataFrame:
    """``docs`` as the mix has them: each row as many times as it is taken.

    The last place that a source and length give becomes a hash up to which
    their documents are taken, so texts are not shuffled: a plan of at most
    ``broadcast`` rows goes to the documents. Only rows that share that very
    hash, repeated rows, are numbered to take as many as planned.
    """
    slim, plans = planned(spark, docs, text, doc_id, source, seed)
    cut = ranked(slim, plans.where("extra > 0 AND extra < n")).where("place = extra - 1").select("key", "size", F.col("hash").alias("cut"))
    # How many rows at the cut are taken: those before it are not.
    at_cut = slim.join(cut, ["key", "size"]).groupBy("key", "size", "cut").agg(F.count(F.when(F.col("hash") < F.col("cut"), 1)).alias("under"), F.count(F.when(F.col("hash") == F.col("cut"), 1)).alias("tied"))
    plans = plans.join(at_cut, ["key", "size"], "left").select(
        "key", "size", "base", F.coalesce("cut", F.lit(0)).alias("cut"),
        F.when(F.col("cut").isNull() & (F.col("extra") > 0), "all").when(F.col("cut").isNull(), "none").otherwise("cut").alias("way"),
        (F.col("extra") - F.col("under")).alias("at_cut"), "tied",
    )
    plans = written(spark, plans.where("base > 0 OR way <> 'none'"), "mix-cuts")
    rows = docs.select(F.struct("*").alias("row"), *keyed(text, doc_id, source, seed))  # one column, whatever the names in it
    if plans.count() <= broadcast:
        joined = rows.join(F.broadcast(plans), ["key", "size"])
    else:  # documents of a length may be many: both sides are salted
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")))
        joined = rows.withColumn("salt", F.pmod("hash", F.lit(16).cast("long"))).join(plans.withColumn("salt", salts), ["key", "size", "salt"])
    tie = (F.col("way") == "cut") & (F.col("hash") == F.col("cut")) & (F.col("at_cut") < F.col("tied"))
    under = (F.col("way") == "all") | ((F.col("way") == "cut") & (F.col("hash") <= F.col("cut")))
    clear = joined.where(~tie).select("row", (F.col("base") + under.cast("long")).alias("copies"))
    ties = written(spark, joined.where(tie).select("row", "key", "size", "base", "at_cut", F.xxhash64(F.monotonically_increasing_id()).alias("any")), "mix-ties")
    ties = rank_in_groups(ties, ["key", "size"], F.col("any"), [], "place").select("row", (F.col("base") + (F.col("place") < F.col("at_cut")).cast("long")).alias("copies"))
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return clear.unionByName(ties).where("copies > 0").withColumn("copy", copy).select("row.*")
