"""A stored inverted index with positions, kept up batch by batch.

Below the index's folder::

    postings/version=V/bucket=B   term, block, doc_ids, lengths, starts, positions
    docs/version=V                doc_id, length, block
    dead/version=V                doc_id, old (version), length, block

Documents are inverted in blocks; a row has all postings of a term in a block
(``starts``: where each posting's positions begin, and where the last end), so
that frequent terms, which are most postings, are few rows to sort.
A term's postings are in the bucket of its hash, sorted by term, so that a
search reads the buckets of its terms and the row groups that hold them. The
length of a text stands in each posting, so that scores need no join. A batch
(one version) adds its documents and marks what it replaces or deletes as
dead; writing a version again overwrites it, so a repeated batch changes
nothing. Searches drop dead postings by an anti join; ``compact`` writes the
live ones as one version.

A search is a structure of ``Phrase``, ``Near``, ``Every``, ``Some`` and
``Without``. Positions of the asked terms meet by document; phrases and
proximity are decided by merging positions, all in column expressions. Scores
are BM25 over phrases, smaller is better; statistics are those of all live
documents, whatever the filters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.text import tokens
from tracelake.operators.search import K1, B
from tracelake.sources.store import exists

#: Folders that postings are dealt into; documents inverted at a time; the folder of the lengths of a version's documents.
BUCKETS, DOCUMENTS, LENGTHS = 64, 4096, -1
#: Terms after which a block ends at the next document.
TERMS = 1 << 21
ROWS = "term string, block long, doc_ids array<long>, lengths array<int>, starts array<int>, positions array<int>"
POSTINGS = f"{ROWS}, version long, bucket int"
DOCS = "doc_id long, length int, block long, version long"
DEAD = "doc_id long, old long, length int, block long, version long"


@dataclass(frozen=True)
class Phrase:
    """Consecutive terms; with ``prefix`` the last is the start of one."""

    words: tuple[str, ...]
    prefix: bool = False

    def __post_init__(self) -> None:
        if not self.words or any(not w for w in self.words):
            raise ValueError("a phrase has terms")


@dataclass(frozen=True)
class Near:
    """All phrases, with at most ``within`` terms between the end of each and the start of the last."""

    phrases: tuple[Phrase, ...]
    within: int = 10


@dataclass(frozen=True)
class Every:
    parts: tuple[Expression, ...]


@dataclass(frozen=True)
class Some:
    parts: tuple[Expression, ...]


@dataclass(frozen=True)
class Without:
    what: Expression
    excluded: Expression


#: What a search asks for.
Expression = Phrase | Near | Every | Some | Without


def word(w: str) -> Phrase:
    return Phrase((w,))


@dataclass(frozen=True)
class Request:
    """A search with its limits: up to 1000 hits, snippets of 1 to 64 terms, 4096 bytes of terms."""

    what: Expression
    limit: int = 50
    snippet_terms: int = 16

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 1000:
            raise ValueError("a limit from 1 to 1000")
        if not 1 <= self.snippet_terms <= 64:
            raise ValueError("snippets of 1 to 64 terms")
        if sum(len(w.encode()) + 1 for p in phrases(self.what) for w in p.words) > 4096:
            raise ValueError("at most 4096 bytes of terms")


def phrases(what: Expression) -> list[Phrase]:
    """All phrases of a search, each once."""
    match what:
        case Phrase():
            return [what]
        case Near():
            found = list(what.phrases)
        case Every() | Some():
            found = [p for x in what.parts for p in phrases(x)]
        case Without():
            found = phrases(what.what) + phrases(what.excluded)
    return list(dict.fromkeys(found))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _stored(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    if not exists(spark, f"{folder}/{name}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def update(spark: SparkSession, folder: str, docs: DataFrame, version: int, doc_id: str = "doc_id", text: str = "text", deleted: DataFrame | None = None) -> None:
    """Writes one batch: ``docs`` are new or replace what has their ids, ``deleted`` has ids that go.

    Versions grow from batch to batch. A null text has no terms; of rows with
    one id in a batch, the one with the greatest text is indexed.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    # Dealt by id at once, over all cores also where the table is small.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    twice = not rows.groupBy("doc_id").count().where("count > 1").isEmpty()  # reads ids alone
    rows = rows.repartition(parts, "doc_id")
    if twice:
        rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"))
    lists = rows.select("doc_id", tokens(F.col("text")).alias("terms")).mapInArrow(_inverted, ROWS)
    # Rebalanced by bucket: a bucket with a frequent term is split among tasks and files.
    dealt = lists.withColumn("bucket", F.when(F.col("term").isNull(), LENGTHS).otherwise(bucket_of(F.col("term")))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings/version={version}")
    docs_path = f"{folder}/docs/version={version}"
    lengths = spark.read.schema(f"{ROWS}, bucket int").parquet(f"{folder}/postings/version={version}").where(F.col("bucket") == LENGTHS)
    lengths.select("block", F.inline(F.arrays_zip("doc_ids", "lengths"))).select(F.col("doc_ids").alias("doc_id"), F.col("lengths").alias("length"), "block").write.mode("overwrite").parquet(docs_path)

    gone = spark.read.schema("doc_id long, length int").parquet(docs_path).select("doc_id")
    if deleted is not None:
        gone = gone.unionByName(deleted.select(F.col(deleted.columns[0]).cast("long").alias("doc_id"))).distinct()
    before = _live(spark, folder, version - 1)
    before.join(gone, "doc_id", "left_semi").select("doc_id", F.col("version").alias("old"), "length", "block").write.mode("overwrite").parquet(f"{folder}/dead/version={version}")


def _rows(terms: pa.Array, block: np.ndarray, n: np.ndarray, doc_ids: pa.Array, lengths: pa.Array, counts: np.ndarray, positions: np.ndarray) -> pa.RecordBatch:
    """Rows with ``n`` postings each, of ``counts`` positions each."""
    first, ends = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(counts)]
    row = np.repeat(np.arange(len(n)), n + 1)
    starts = ends[np.arange(len(row)) - row] - ends[first[:-1]][row]
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
    columns = [
        terms, pa.array(block, pa.int64()), lists(first, doc_ids), lists(first, lengths),
        lists(first + np.arange(len(first)), pa.array(starts, pa.int32())), lists(ends[first], pa.array(positions, pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["term", "block", "doc_ids", "lengths", "starts", "positions"])


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of each block of documents, and one without a term for their lengths."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        first, ends = 0, batch.column("terms").offsets.to_numpy()
        while first < batch.num_rows:
            fits = int(np.searchsorted(ends, ends[first] + TERMS)) - first
            part = batch.slice(first, min(DOCUMENTS, max(fits, 1)))
            first += part.num_rows
            lists, ids, block = part.column("terms"), part.column("doc_id"), block + 1
            lengths = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            coded = lists.flatten().dictionary_encode()
            code = coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")  # documents and positions ascend
            code, doc, place = code[order], doc[order], place[order]
            new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.empty(0, np.int64)
            term = np.flatnonzero(np.r_[True, np.diff(code[new]) != 0]) if len(new) else new
            n, who = np.diff(np.r_[term, len(new)]), doc[new]
            yield _rows(coded.dictionary.take(pa.array(code[new][term])).cast(pa.string()), np.full(len(n), block), n, ids.take(pa.array(who)), pa.array(lengths[who], pa.int32()), np.diff(np.r_[new, len(doc)]), place)
            none = np.zeros(len(lengths), np.int64)
            yield _rows(pa.nulls(1, pa.string()), np.array([block]), np.array([len(lengths)]), ids, pa.array(lengths, pa.int32()), none, none[:0])


def _without_dead(own: pa.Table, dead: pa.Table) -> pa.Table:
    """A block's rows without the postings of dead documents."""
    if not own.num_rows:
        return pa.Table.from_batches([], own.schema).select(["term", "block", "doc_ids", "lengths", "starts", "positions"])
    at = {c: own.column(c).combine_chunks() for c in ("term", "block", "doc_ids", "lengths", "starts", "positions")}
    flat = {c: at[c].flatten() for c in ("doc_ids", "lengths", "starts", "positions")}
    n = np.diff(at["doc_ids"].offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(row)) + row  # a row has one start more than postings
    starts = flat["starts"].to_numpy()
    counts = starts[first + 1] - starts[first]
    keep = ~np.isin(flat["doc_ids"].to_numpy(), dead.column("doc_id").to_numpy())
    left = np.bincount(row[keep], minlength=len(n))
    some = left > 0
    said = flat["positions"].to_numpy()[np.repeat(keep, counts)]
    kept = pa.array(keep)
    return pa.Table.from_batches([_rows(at["term"].filter(pa.array(some)), at["block"].to_numpy()[some], left[some], flat["doc_ids"].filter(kept), flat["lengths"].filter(kept), counts[keep], said)])


def _live(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """doc_id, length, block, version of the documents that stand (after a version)."""
    docs, dead = _stored(spark, folder, "docs", DOCS), _stored(spark, folder, "dead", DEAD)
    if version is not None:
        docs, dead = docs.where(F.col("version") <= version), dead.where(F.col("version") <= version)
    return docs.join(dead.select("doc_id", F.col("old").alias("version")), ["doc_id", "version"], "left_anti")


def compact(spark: SparkSession, folder: str, into: str, version: int = 0) -> None:
    """The live postings of an index as one version of a new index."""
    dead = _stored(spark, folder, "dead", DEAD).select("doc_id", F.col("old").alias("version"), "block")
    rows = _stored(spark, folder, "postings", POSTINGS).where(F.col("bucket") != LENGTHS)
    live = rows.groupBy("version", "block").cogroup(dead.groupBy("version", "block")).applyInArrow(_without_dead, ROWS)
    live = live.withColumn("bucket", bucket_of(F.col("term")))
    live.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{into}/postings/version={version}")
    _live(spark, folder).select("doc_id", "length", "block").write.mode("overwrite").parquet(f"{into}/docs/version={version}")


def postings(spark: SparkSession, folder: str, words: list[str], prefixes: list[str]) -> DataFrame:
    """The live postings of the words and of terms with the prefixes; only words name their buckets."""
    asked = reduce(lambda a, b: a | b, [F.col("term").isin(*words)] * bool(words) + [F.col("term").startswith(p) for p in prefixes])
    found = _stored(spark, folder, "postings", POSTINGS)
    if not prefixes:
        found = found.where(F.col("bucket").isin(*(bucket_of(F.lit(w)) for w in words)))
    dead = _stored(spark, folder, "dead", DEAD).select("doc_id", F.col("old").alias("version"))
    begins = lambda i: F.get("starts", i)
    said = F.transform("doc_ids", lambda d, i: F.struct(d.alias("doc_id"), F.get("lengths", i).alias("length"), F.slice("positions", begins(i) + 1, begins(i + 1) - begins(i)).alias("positions")))
    found = found.where(asked).select("term", F.inline(said), "version", "bucket")
    return found.join(dead, ["doc_id", "version"], "left_anti")


def statistics(spark: SparkSession, folder: str) -> DataFrame:
    """One row: n documents, total length."""
    plus = _stored(spark, folder, "docs", DOCS).select(F.lit(1).alias("one"), "length")
    minus = _stored(spark, folder, "dead", DEAD).select(F.lit(-1).alias("one"), (-F.col("length")).alias("length"))
    return plus.unionByName(minus).agg(F.coalesce(F.sum("one"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total"))


def _phrase_starts(at: dict[tuple[str, bool], Column], phrase: Phrase) -> Column:
    """Where a phrase starts: places of its first term that all others follow."""
    last = len(phrase.words) - 1

    def moved(places: Column, by: int) -> Column:
        return F.transform(places, lambda x: x - by) if by else places

    return reduce(F.array_intersect, (moved(at[w, phrase.prefix and i == last], i) for i, w in enumerate(phrase.words)))


def _near(starts: list[Column], sizes: list[int], within: int) -> Column:
    """Whether some places of all phrases lie close, by one merge of their positions.

    At each place the latest starts of the phrases so far are the closest; all
    must end ``within`` terms before it, or later.
    """
    never = -(1 << 30)

    def marked(places: Column, which: int) -> Column:
        return F.transform(places, lambda x: F.struct(x.alias("at"), F.lit(which).alias("which")))

    places = F.array_sort(F.concat(*(marked(s, i) for i, s in enumerate(starts))))
    reach = F.array(*(F.lit(n + within) for n in sizes))

    def step(state: Column, place: Column) -> Column:
        latest = F.transform(state["latest"], lambda x, i: F.when(i == place["which"], place["at"]).otherwise(x))
        close = F.forall(F.zip_with(latest, reach, lambda x, r: place["at"] - x <= r), lambda c: c)
        return F.struct(latest.alias("latest"), (state["found"] | close).alias("found"))

    start = F.struct(F.array(*[F.lit(never)] * len(starts)).alias("latest"), F.lit(False).alias("found"))
    return F.aggregate(places, start, step, lambda s: s["found"])


def _holds(what: Expression, count: dict[Phrase, Column], starts: dict[Phrase, Column]) -> Column:
    match what:
        case Phrase():
            return count[what] > 0
        case Near():
            both = reduce(lambda a, b: a & b, [count[p] > 0 for p in what.phrases])
            return both & _near([starts[p] for p in what.phrases], [len(p.words) for p in what.phrases], what.within)
        case Every():
            return reduce(lambda a, b: a & b, [_holds(x, count, starts) for x in what.parts])
        case Some():
            return reduce(lambda a, b: a | b, [_holds(x, count, starts) for x in what.parts])
        case Without():
            return _holds(what.what, count, starts) & ~_holds(what.excluded, count, starts)


def matched(spark: SparkSession, folder: str, what: Expression) -> DataFrame:
    """doc_id, score of all documents that satisfy a search."""
    asked = phrases(what)
    slots = list(dict.fromkeys((w, p.prefix and i == len(p.words) - 1) for p in asked for i, w in enumerate(p.words)))
    found = postings(spark, folder, [w for w, prefix in slots if not prefix], [w for w, prefix in slots if prefix])
    fits = [F.col("term").startswith(w) if prefix else F.col("term") == w for w, prefix in slots]
    by_doc = found.groupBy("doc_id", "length").agg(*(F.flatten(F.collect_list(F.when(fit, F.col("positions")))).alias(f"at{i}") for i, fit in enumerate(fits)))
    at = {slot: F.col(f"at{i}") for i, slot in enumerate(slots)}
    by_doc = by_doc.select("doc_id", "length", *(_phrase_starts(at, p).alias(f"starts{i}") for i, p in enumerate(asked)))
    starts = {p: F.col(f"starts{i}") for i, p in enumerate(asked)}
    count = {p: F.size(s) for p, s in starts.items()}
    counted = by_doc.select("doc_id", "length", *(count[p].alias(f"f{i}") for i, p in enumerate(asked)), _holds(what, count, starts).alias("hit"))
    frequency = counted.agg(*(F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"df{i}") for i in range(len(asked))))
    # Both statistics are one row.
    scored = counted.where("hit").crossJoin(F.broadcast(frequency)).crossJoin(F.broadcast(statistics(spark, folder)))
    n, mean = F.col("n"), F.col("total") / F.col("n")

    def part(i: int) -> Column:
        df, f = F.col(f"df{i}"), F.col(f"f{i}")
        idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / mean))

    return scored.select("doc_id", (-reduce(lambda a, b: a + b, map(part, range(len(asked))))).alias("score"))


def allowed(events: DataFrame, id_column: str, now: Column, sessions: DataFrame | None = None, include_held: bool = False, since: Column | None = None, **fields: tuple) -> DataFrame:
    """doc_id of the events that a search may show: by field values, time, and the hold state of their session.

    events: the id, ``session``, ``event_at`` and the fields asked for;
    sessions: ``session``, ``hold_state``, ``embargo_until``. Events of
    sessions that aren't listed are shown.
    """
    rows = events
    for name, values in fields.items():
        rows = rows.where(F.col(name).isin(*values))
    if since is not None:
        rows = rows.where(F.col("event_at") >= since)
    if sessions is not None and not include_held:
        embargo = (F.col("hold_state") == "embargoed") & (F.col("embargo_until").isNull() | (F.col("embargo_until") > now))
        held = sessions.where((F.col("hold_state") == "pending_review") | embargo).select("session").distinct()
        rows = rows.join(held, "session", "left_anti")
    return rows.select(F.col(id_column).cast("long").alias("doc_id"))


def search(spark: SparkSession, folder: str, request: Request, among: DataFrame | None = None) -> DataFrame:
    """doc_id, score, rows_matched: the best hits, ties by id, and how many there are without the limit."""
    hits = matched(spark, folder, request.what)
    if among is not None:
        hits = hits.join(among, "doc_id", "left_semi")
    total = hits.agg(F.count(F.lit(1)).alias("rows_matched"))
    return hits.orderBy("score", "doc_id").limit(request.limit).crossJoin(F.broadcast(total))
