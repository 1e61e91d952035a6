"""Full-text search: BM25, phrases, gates, families.

Structured terms stand for the match expression: all of these, any of those,
none of these, a phrase, a prefix.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import tokens

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Search:
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    phrase: tuple[str, ...] = ()
    prefix: str | None = None
    limit: int = 50

    def __post_init__(self) -> None:
        if not (self.all_of or self.any_of or self.phrase or self.prefix):
            raise ValueError("a search needs a term that must be there")
        if not 1 <= self.limit <= 1000:
            raise ValueError("a limit from 1 to 1000")


def bm25(docs: DataFrame, spec: Search, terms: tuple[str, ...], doc_id: str, text: str) -> DataFrame:
    """doc_id, score of the documents that satisfy the spec; smaller is better.

    Counts of the terms and whether a document satisfies the spec come from
    each row itself, so that no posting is shuffled; document counts of the
    terms are one row.
    """
    times = lambda t, w: F.size(F.filter(t, lambda x: x == w))
    counts = [F.col(f"tf{i}") for i in range(len(terms))]

    def facts(t: Column) -> Column:
        return F.struct(F.size(t).alias("length"), satisfied(t, spec).alias("hit"), *(times(t, w).alias(f"tf{i}") for i, w in enumerate(terms)))

    # Exploded, as filters on these columns would find a text's terms again for each of them.
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.transform(F.array(tokens(F.col(text))), facts)).alias("facts")).select("doc_id", "facts.*")
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"), *(F.count(F.when(tf > 0, 1)).alias(f"df{i}") for i, tf in enumerate(counts)))
    hits = counted.where(F.col("hit") & (reduce(lambda a, b: a + b, counts) > 0))
    joined = hits.crossJoin(F.broadcast(stats))  # one row
    mean = F.col("total") / F.col("n")

    def part(i: int) -> Column:
        n, df, f = F.col("n"), F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / mean))

    score = reduce(lambda a, b: a + b, map(part, range(len(terms))))
    return joined.select("doc_id", (-score).alias("score"))


def satisfied(t: Column, spec: Search) -> Column:
    """Whether a text's terms satisfy the spec; phrases are consecutive terms."""
    every = F.lit(True)
    for w in spec.all_of:
        every = every & F.array_contains(t, w)
    if spec.any_of:
        every = every & F.arrays_overlap(t, F.array(*map(F.lit, spec.any_of)))
    for w in spec.none_of:
        every = every & ~F.array_contains(t, w)
    if spec.phrase:
        joined = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
        every = every & F.contains(joined, F.lit(" " + " ".join(spec.phrase) + " "))
    if spec.prefix:
        every = every & F.exists(t, lambda x: x.startswith(spec.prefix))
    return every


def matches(text: Column, spec: Search) -> Column:
    return satisfied(tokens(text), spec)


def search(docs: DataFrame, spec: Search, doc_id: str, text: str) -> DataFrame:
    """The best documents by BM25 over all the spec's terms, ties by id."""
    terms = tuple(dict.fromkeys((*spec.all_of, *spec.any_of, *spec.phrase)))
    if terms:
        scored = bm25(docs, spec, terms, doc_id, text)
    else:
        scored = docs.where(matches(F.col(text), spec)).select(F.col(doc_id).alias("doc_id"), F.lit(0.0).alias("score"))
    return scored.orderBy("score", "doc_id").limit(spec.limit)


def visible(sessions: DataFrame, now: Column) -> Column:
    """Sessions that searches may show: released, automatic, or an embargo that is over."""
    state = F.col("hold_state")
    return state.isNull() | state.isin("auto_redacted", "released") | ((state == "embargoed") & (F.col("embargo_until") <= now))


def snippet(text: Column, term: str, around: int = 5) -> Column:
    """Terms around the first hit."""
    t = tokens(text)
    at = F.array_position(t, term).cast("int")
    return F.when(at > 0, F.array_join(F.slice(t, F.greatest(at - around, F.lit(1)), F.lit(2 * around + 1)), " "))
