"""Lessons that say the same, and a ranked selection without them.

lessons: ``place`` (rank, unique, from the best), ``kind``, ``taxonomy``,
``origin``, ``title``, ``guidance``, ``trigger``, ``fresh`` (proposed in this
run, else carried over), ``support``.

Pairs that may be alike meet on equal titles, on two common stems of titles,
on a failure mode, on equal guidance, or on a rare stem of their guidance (a
prefix of each sorted set that any pair of enough similarity shares); the
rules then decide on each pair. The selection is that of a walk in rank order,
made in rounds of joins: a lesson is decided as soon as what it depends on is.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that say nothing, and limits of similarity.
STOP = (
    "the a an to of in on and or for with is are be that this it its your you not never always before after when so than then them they into from by at as if do dont use "
    "using ensure make sure any all each every rather instead only"
).split()
TITLE, BODY, SAME_KIND, CROSS_KIND = 0.5, 0.15, 0.3, 0.4
OBJECTIVE = "objective"


def stem(w: Column) -> Column:
    """A word without plural, -ing, -ed and a doubled last consonant."""
    w = F.when(w.endswith("s") & (F.length(w) > 3), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    ing, ed = w.endswith("ing") & (F.length(w) > 6), w.endswith("ed") & (F.length(w) > 4)
    w = F.when(ing, F.substring(w, F.lit(1), F.length(w) - 3)).when(ed, F.substring(w, F.lit(1), F.length(w) - 2)).otherwise(w)
    return F.when((F.length(w) > 3) & w.rlike(r"([^aeiou])\1$"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def stems(text: Column, least: int) -> Column:
    """Stems of the words of ``least`` characters or more that say something, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.transform(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*STOP)), stem)


def described(lessons: DataFrame) -> DataFrame:
    """With the sets of stems that comparisons need."""
    return lessons.withColumns({
        "_title": F.lower(F.trim(F.coalesce("title", F.lit("")))), "_order": stems(F.col("title"), 1), "_titles": F.array_distinct(stems(F.col("title"), 1)),
        "_guide": F.array_distinct(stems(F.col("guidance"), 3)), "_trigger": F.array_distinct(stems(F.col("trigger"), 3)), "_same": F.trim(F.coalesce("guidance", F.lit(""))),
    })


def candidate_pairs(lessons: DataFrame) -> DataFrame:
    """u, v (u before v): all pairs that can be alike, and few others."""
    counts = lessons.select(F.explode("_guide").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ranked = lessons.select("place", F.size("_guide").alias("n"), F.explode("_guide").alias("w")).join(counts, "w")
    sorted_ = ranked.groupBy("place", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("s"))
    # A pair of similarity t shares one of the n - ceil(t n) + 1 rarest of each.
    prefix = F.slice("s", F.lit(1), F.greatest(F.col("n") - F.ceil(F.col("n") * SAME_KIND - 1e-9).cast("int") + 1, F.lit(1)))
    rare = sorted_.select("place", F.transform(prefix, lambda x: F.concat(F.lit("w:"), x["w"])).alias("k"))
    t = F.array_sort("_titles")
    twos = F.flatten(F.transform(t, lambda a: F.transform(F.filter(t, lambda b: a < b), lambda b: F.concat_ws(":", F.lit("t"), a, b))))
    keys = F.array(
        F.when(F.col("_title") != "", F.concat(F.lit("="), F.col("_title"))), F.when(F.coalesce("taxonomy", F.lit("")) != "", F.concat_ws(":", F.lit("m"), "kind", "taxonomy")),
        F.concat_ws(":", F.lit("g"), F.coalesce("kind", F.lit("")), F.sha2("_same", 256)),
    )
    own = lessons.select("place", F.explode(F.concat(F.array_compact(keys), twos)).alias("k")).unionByName(rare.select("place", F.explode("k").alias("k"))).distinct()
    return own.alias("a").join(own.alias("b"), F.expr("a.k = b.k AND a.place < b.place")).select(F.col("a.place").alias("u"), F.col("b.place").alias("v")).distinct()


def overlap(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def scope_swap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether one title puts another word in place of one that isn't the first."""

    def swapped(x: list[str], y: list[str]) -> bool:
        if not x or not y or x[0] != y[0]:
            return False
        return any(tag == "replace" and i > 0 and j > 0 for tag, i, _, j, _ in SequenceMatcher(None, x, y, autojunk=False).get_opcodes())

    return pd.Series([swapped(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype=bool)


def alike(lessons: DataFrame) -> DataFrame:
    """u, v: pairs of lessons that teach the same."""
    wide = described(lessons)
    a, b = (wide.select(*(F.col(c).alias(f"{side}{c}") for c in wide.columns)) for side in ("u_", "v_"))
    pairs = candidate_pairs(wide).join(a, F.col("u") == F.col("u_place")).join(b, F.col("v") == F.col("v_place"))
    both = lambda c: (F.col(f"u_{c}"), F.col(f"v_{c}"))

    def equal(c: str) -> Column:
        x, y = both(c)
        return F.coalesce((x == y) & (x != ""), F.lit(False))

    def corroborates(c: str) -> Column:
        x, y = both(c)
        shared = F.size(F.array_intersect(x, y))
        return (shared >= 2) & (shared >= BODY * F.least(F.size(x), F.size(y)))

    tx, ty = both("_titles")
    shared = F.size(F.array_intersect(tx, ty))
    extends = (shared == F.size(tx)) | (shared == F.size(ty))
    near = (shared >= 2) & (extends | (shared >= TITLE * F.size(F.array_union(tx, ty)))) & (equal("taxonomy") | corroborates("_guide") | corroborates("_trigger"))
    same_kind = F.col("u_kind").eqNullSafe(F.col("v_kind"))
    words = overlap(*both("_guide"))
    by_words = F.when(same_kind, equal("taxonomy") | (words >= SAME_KIND)).otherwise(words >= CROSS_KIND)
    facts = F.coalesce((F.col("u_origin") == OBJECTIVE) & (F.col("v_origin") == OBJECTIVE), F.lit(False))
    judged = pairs.withColumn("_near", near).withColumn("_swap", F.when(F.col("_near"), F.pandas_udf(scope_swap, "boolean")(*both("_order"))).otherwise(False))
    said = F.when(facts, same_kind & (F.col("u__same") == F.col("v__same"))).otherwise(equal("_title") | (F.col("_near") & ~F.col("_swap")) | by_words)
    return judged.where(said).select("u", "v")


def selected(lessons: DataFrame, pairs: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """place, slot, support of the lessons that stay: one of those alike, as a walk in rank order chooses.

    The first of its like opens a slot. A carried lesson takes the slot of a
    fresh one that it is like, and what comes later is compared with it; of
    several slots the first counts. A carried lesson has the greatest support
    of the fresh ones it stands for. ``write`` stores a round's table.
    """
    pairs = write(pairs, "pairs")
    state = write(lessons.select("place", "fresh", "support", F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("slot")), "round-0")
    rounds = 0
    while not state.where("status IS NULL").isEmpty():
        rounds += 1
        of = lambda side: state.select(*(F.col(c).alias(f"{side}_{c}") for c in ("place", "fresh", "status", "slot")))  # noqa: E731, B023
        open_ = state.where("status IS NULL").select(F.col("place").alias("v"), F.col("fresh").alias("v_fresh"))
        near = pairs.join(open_, "v").join(of("u"), F.col("u") == F.col("u_place"))
        waits = near.where("u_status IS NULL").select("v")
        # A fresh lesson's slot may have gone to a carried one before v.
        fresh = near.where("u_status = 'kept' AND u_fresh").select("v", "u")
        takers = fresh.join(pairs.select("u", F.col("v").alias("w")), "u").where("w < v").join(of("w").where("NOT w_fresh"), F.col("w") == F.col("w_place"))
        waits = waits.unionByName(takers.where("w_status IS NULL").select("v")).distinct()
        gone = takers.where("w_status = 'took' AND w_slot = u").select("v", "u").distinct()
        reps = near.where("u_status = 'took' OR u_status = 'kept'").join(gone, ["v", "u"], "left_anti")
        first = reps.groupBy("v").agg(F.min(F.struct(F.col("u_slot").alias("slot"), F.col("u_fresh").alias("fresh"))).alias("s"))
        decided = open_.join(waits, "v", "left_anti").join(first, "v", "left")
        status = F.when(F.col("s").isNull(), "kept").when(F.col("s.fresh") & ~F.col("v_fresh"), "took").when(~F.col("s.fresh") & F.col("v_fresh"), "backs").otherwise("dropped")
        decided = decided.select(F.col("v").alias("place"), status.alias("now"), F.coalesce("s.slot", "v").alias("at"))
        state = state.join(decided, "place", "left").select("place", "fresh", "support", F.coalesce("status", "now").alias("status"), F.coalesce("slot", "at").alias("slot"))
        state = write(state, f"round-{rounds}")
    slots = state.where("status <> 'dropped'").groupBy("slot").agg(
        F.max(F.when(F.col("status") == "took", F.col("place"))).alias("took"), F.max(F.when(F.col("status") == "kept", F.col("place"))).alias("kept"), F.max("support").alias("support")
    )
    return slots.select(F.coalesce("took", "kept").alias("place"), "slot", "support")
