"""N-gram Jaccard self-join by prefix trees.

A document is the set of its distinct word 5-grams. Two documents link when
the Jaccard similarity of their sets reaches the threshold; the result is the
components of these links and every document's number of links.

1. One pass hashes the sets. Documents with equal sets form a class. Tasks
   send the n-grams of their classes, once each and packed by hash slot; a
   slot tells how many n-grams of each class occur elsewhere too. A document
   with a partner shares at least the threshold's part of its own n-grams, so
   most documents drop out here.
2. Only survivors' sets are kept. Slots count each n-gram's classes and name
   one of them its centre. N-grams are ordered globally by (count, hash);
   linked sets share an n-gram of their prefixes in that order, and so a
   centre, to whose bucket both are sent. Large buckets are dealt as pairs of
   blocks.
3. In a bucket the sets are stored in a trie, in that global order, frequent
   n-grams first, so that similar sets share a path. Blocks of probe sets walk it together: the
   overlap with a path counts for all sets below, and a probe leaves a
   subtree when its overlap and the remaining lengths can't reach the
   threshold. Links are counted and spanning edges found from the probes that
   reach a set, without a list of pairs.
4. Classes that hold one id are joined through it, then components are found.

All filters are exact bounds. N-grams are compared by 64-bit hashes, classes
by 128-bit digests of their sets.

Defined results: without words or text a document has no n-grams and links
with nothing; with fewer words than n the whole sequence is the one n-gram;
rows without an id get their n_shingles, no links and a null component; rows
of one id are one document's, so they share its component whatever their
texts, and the links of each count for all (n_links is that of the row's own
text, its copies among the rows included); ties need no rule, as every link
counts; further columns are left out; an empty table gives no rows; all
n-grams of a text count, however long it is.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import WordHashes, groups_for, id_filter, mixed, shuffle_partitions, windows, written
from tracelake.llm.components import components

WORDS = 5
#: Similarity that links, in percent; all bounds are whole-number arithmetic.
PERCENT = 75
#: n-grams that a task gathers before it sends them; n-grams in a block of a bucket.
GATHER, BUCKET = 1_000_000, 40_000
PROBES = 64
SALTS = 16

PACKED = "slot int, block string, kind int, data binary"
SETS = "doc_id long, cls string, n long, block string, grams binary"
LINKS = "rep long, root long, cls string, links long"
NEAR = "cls string, n long, centres array<long>, grams binary"


def gram_set(known: WordHashes, text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word k-grams of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # ASCII case, ASCII spaces
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return mixed(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64))
    return np.unique(windows(known.of(words), k))


def class_of(grams: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(grams.tobytes()) if len(grams) else ""


def slots_of(grams: np.ndarray, slots: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


# --- 1. which documents can have a partner -------------------------------------------------


def _packed_block(block: str, ids: list, sets: list[np.ndarray], slots: int) -> Iterator[tuple]:
    """Rows for the slots, and one with the block's documents.

    Each distinct n-gram goes out once. Those that two classes of the block
    have are shared already; they go under the number after the last class.
    """
    classes: dict[str, int] = {}
    own, unique = [], []
    for grams in sets:
        c = class_of(grams)
        if c not in classes:
            classes[c] = len(classes)
            unique.append(grams)
        own.append(classes[c])
    m = len(unique)
    grams = np.concatenate(unique)
    holder = np.repeat(np.arange(m, dtype=np.int32), [len(g) for g in unique])
    order = np.argsort(grams, kind="stable")
    grams, holder = grams[order], holder[order]
    first = np.ones(len(grams), bool)
    first[1:] = grams[1:] != grams[:-1]
    alone = first.copy()
    alone[:-1] &= first[1:]
    local = np.bincount(holder[~alone], minlength=m)
    grams, holder = grams[first], np.where(alone, holder, m)[first]
    slot = slots_of(grams, slots)
    cell = slot * (m + 1) + holder
    order = np.argsort(cell, kind="stable")
    low = (grams[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    counts = np.bincount(cell, minlength=slots * (m + 1)).reshape(slots, m + 1)
    ends = np.concatenate([[0], np.cumsum(counts.sum(axis=1))])
    for s in range(slots):
        if ends[s + 1] > ends[s]:
            yield s, block, 0, pickle.dumps((_small(counts[s]), low[ends[s] : ends[s + 1]]))
    table = (ids, own, np.array([len(g) for g in unique]), list(classes), local)
    yield xxhash.xxh32_intdigest(block) % slots, block, 1, pickle.dumps(table)


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _send(docs: DataFrame, slots: int, k: int) -> DataFrame:
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, part = WordHashes.kept(), TaskContext.get().partitionId()
        ids, sets, size, number = [], [], 0, 0

        def flush() -> Iterator[pd.DataFrame]:
            rows = list(_packed_block(f"{part}-{number}", ids, sets, slots))
            for at in range(0, len(rows), 16):
                yield _frame(rows[at : at + 16], PACKED)

        for pdf in frames:
            for key, text in zip(pdf["doc_id"].array, pdf["text"].array, strict=True):
                ids.append(None if pd.isna(key) else int(key))
                sets.append(gram_set(known, text, k))
                size += len(sets[-1]) + 1
                if size >= GATHER:
                    yield from flush()
                    ids, sets, size, number = [], [], 0, number + 1
        if ids:
            yield from flush()

    return docs.mapInPandas(batches, PACKED)


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """A slot's answer to each block: how many of each class's n-grams occur in two classes or blocks."""
    asked = pdf[pdf["kind"] == 0]
    out = [(r.block, 1, r.data) for r in pdf[pdf["kind"] == 1].itertuples(index=False)]
    sent = [pickle.loads(d) for d in asked["data"]]
    if sent:
        grams = np.concatenate([g for _, g in sent])
        order = np.argsort(grams, kind="stable")
        ordered = grams[order]
        same = np.zeros(len(grams), bool)
        same[1:] = ordered[1:] == ordered[:-1]
        same[:-1] |= same[1:]
        both = np.empty(len(grams), bool)
        both[order] = same
        at = 0
        for block, (counts, own) in zip(asked["block"], sent, strict=True):
            holder = np.repeat(np.arange(len(counts)), counts)
            hits = np.bincount(holder[both[at : at + len(own)]], minlength=len(counts))[:-1]
            out.append((block, 0, pickle.dumps(_small(hits))))
            at += len(own)
    return _frame(out, "block string, kind int, data binary")


def _per_document(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, own, n, classes, local = pickle.loads(pdf.loc[pdf["kind"] == 1, "data"].iloc[0])
    total = local.astype(np.int64)
    for d in pdf.loc[pdf["kind"] == 0, "data"]:
        total += pickle.loads(d)
    own = np.array(own, int)
    return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_shingles": n[own], "cls": np.array(classes, object)[own], "shared": total[own]})


# --- 2. prefixes and buckets ---------------------------------------------------------------


def _survivor_sets(docs: DataFrame, hopeful: DataFrame, k: int) -> DataFrame:
    """Sets of the documents that may stand for surviving classes, in blocks of bounded size."""

    may_be = id_filter(hopeful)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, part, number, size = WordHashes.kept(), TaskContext.get().partitionId(), 0, 0
        for pdf in frames:
            rows = []
            for r in pdf[may_be(pdf["doc_id"])].itertuples(index=False):
                grams = gram_set(known, r.text, k)
                rows.append((r.doc_id, class_of(grams), len(grams), f"{part}-{number}", grams.tobytes()))
                size += len(grams)
                if size >= GATHER:
                    number, size = number + 1, 0
            yield _frame(rows, SETS)

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(batches, SETS)


def _block_grams(pdf: pd.DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-grams in slot order, their counts, smallest class number, slot) of a block."""
    grams = np.concatenate([np.frombuffer(g, np.uint64) for g in pdf["grams"]])
    number = np.repeat(np.array([int(c[:16], 16) for c in pdf["cls"]], np.uint64), pdf["n"].to_numpy())
    order = np.lexsort((number, grams))
    grams, number = grams[order], number[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    count = np.diff(np.concatenate([first, [len(grams)]]))
    grams, number = grams[first], number[first]
    slot = slots_of(grams, slots)
    by_slot = np.argsort(slot, kind="stable")
    return grams[by_slot], count[by_slot], number[by_slot], slot[by_slot]


def _ask(pdf: pd.DataFrame, slots: int) -> pd.DataFrame:
    grams, count, number, slot = _block_grams(pdf, slots)
    ends = np.searchsorted(slot, np.arange(slots + 1))
    rows = [(s, pdf["block"].iloc[0], 0, pickle.dumps((grams[a:b], _small(count[a:b]), number[a:b]))) for s, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
    return _frame(rows, PACKED)


def _tell(pdf: pd.DataFrame) -> pd.DataFrame:
    """For the n-grams that blocks ask about: number of classes, and the centre."""
    sent = [pickle.loads(d) for d in pdf["data"]]
    grams, count, number = (np.concatenate(x) for x in zip(*sent, strict=True))
    distinct, at = np.unique(grams, return_inverse=True)
    total = np.bincount(at, weights=count, minlength=len(distinct)).astype(np.int64)
    centre = np.full(len(distinct), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(centre, at, number)
    out, a = [], 0
    for slot, block, (own, _, _) in zip(pdf["slot"], pdf["block"], sent, strict=True):
        j = at[a : a + len(own)]
        out.append((slot, block, 0, pickle.dumps((_small(total[j]), np.where(total[j] > 1, centre[j], np.uint64(0))))))
        a += len(own)
    return _frame(out, PACKED)


def _centres(sets: pd.DataFrame, told: pd.DataFrame, slots: int, percent: int) -> pd.DataFrame:
    """cls, n, centres of the n-grams in the prefix of each set that others have too; and the
    set's n-grams in global order, the last first, with their counts."""
    if not len(sets) or not len(told):
        return _frame([], NEAR)
    grams, _, _, _ = _block_grams(sets, slots)
    answers = [pickle.loads(d) for d in told.sort_values("slot")["data"]]
    count, centre = (np.concatenate(x) for x in zip(*answers, strict=True))
    by_gram = np.argsort(grams)
    grams, count, centre = grams[by_gram], count[by_gram].astype(np.int64), centre[by_gram]
    rows = []
    for cls, n, raw in zip(sets["cls"], sets["n"], sets["grams"], strict=True):
        at = np.searchsorted(grams, np.frombuffer(raw, np.uint64))
        c = count[at]
        if 100 * int((c > 1).sum()) >= percent * n:
            ordered = at[np.argsort(c, kind="stable")]
            prefix = ordered[: n - -(-percent * n // 100) + 1]
            found = np.unique(centre[prefix][count[prefix] > 1])
            if len(found):
                ordered = ordered[::-1]
                rows.append((cls, n, found.view(np.int64), pickle.dumps((grams[ordered], _small(count[ordered])))))
    return _frame(rows, NEAR)


# --- 3. the trie ---------------------------------------------------------------------------


class Trie:
    """Sets of numbers, sorted as sequences; a node is a range of them with its depth.

    Sets below a node share their first ``depth`` numbers. Paths without a
    branch are one node.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets])
        common = [0]
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            m = min(len(a), len(b))
            different = np.flatnonzero(a[:m] != b[:m])
            common.append(int(different[0]) if len(different) else m)
        self.common = np.array(common)  # numbers shared with the set before

    def links(self, probe: np.ndarray, before: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, int]]:
        """(probe numbers, set number) that reach the threshold.

        probe: which numbers each probe has; before: how many of them are
        below a number; n: their sizes.
        """
        todo = [(0, len(self.sets), 0, np.arange(len(n)), np.zeros(len(n), np.int64))]
        while todo:
            low, high, depth, who, overlap = todo.pop()
            end = int(self.common[low + 1 : high].min()) if high - low > 1 else int(self.sizes[low])
            part = self.sets[low][depth:end]
            if len(part):
                overlap = overlap + probe[np.ix_(who, part)].sum(axis=1)
            sizes = self.sizes[low:high]
            least, most = int(sizes.min()), int(sizes.max())
            left = n[who] - before[who, self.sets[low][end - 1] + 1] if end else n[who]
            # |x & y| / |x | y| >= p  <=>  (1 + p) |x & y| >= p (|x| + |y|)
            reach = (100 + percent) * (overlap + np.minimum(left, most - end)) >= percent * (n[who] + least)
            who, overlap = who[reach], overlap[reach]
            if not len(who):
                continue
            while low < high and self.sizes[low] == end:  # these end here
                hit = (100 + percent) * overlap >= percent * (n[who] + end)
                if hit.any():
                    yield who[hit], self.order[low]
                low += 1
            if low < high:
                cuts = [low, *(low + 1 + np.flatnonzero(self.common[low + 1 : high] == end)), high]
                todo += [(a, b, end, who, overlap) for a, b in zip(cuts, cuts[1:], strict=False)]


def coded(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], int]:
    """The sets (n-grams, their counts) as sorted places in the global order, and how many places there are."""
    grams, counts = (np.concatenate(x) for x in zip(*sets, strict=True))
    distinct, first, at = np.unique(grams, return_index=True, return_inverse=True)
    rank = np.empty(len(distinct), np.int64)
    rank[np.lexsort((distinct, counts[first].astype(np.int64)))[::-1]] = np.arange(len(distinct))
    return [np.sort(x) for x in np.split(rank[at], np.cumsum([len(g) for g, _ in sets])[:-1])], len(distinct)


def linked(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]] | None, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, int]]:
    """(numbers i, number j) of left and right sets that link; without right i < j in left."""
    if not left or right == []:
        return
    sets, places = coded(left + (right or []))
    probes, trie = sets[: len(left)], Trie(sets[len(left) :] if right is not None else sets)
    for first in range(0, len(probes), PROBES):
        block = probes[first : first + PROBES]
        has = np.zeros((len(block), places), bool)
        for i, p in enumerate(block):
            has[i, p] = True
        before = np.zeros((len(block), places + 1), np.int32)
        np.cumsum(has, axis=1, out=before[:, 1:])
        for who, j in trie.links(has, before, np.array([len(p) for p in block]), percent):
            who = who + first
            if right is None:
                who = who[who < j]
            if len(who):
                yield who, j


def meetings(centres: list[np.ndarray], centre: int) -> Callable[[np.ndarray], np.ndarray] | None:
    """For some of the sets: a row each, which of all sets have a smaller centre in common with it,
    where they meet too; None if no two have. Memory is that of the rows and of the centres, not of all pairs."""
    own = [c[c < centre] for c in centres]
    every = np.concatenate(own)
    _, at, count = np.unique(every, return_inverse=True, return_counts=True)
    if not (count > 1).any():
        return None
    number, n = np.cumsum(count > 1) - 1, int((count > 1).sum())
    row = np.repeat(np.arange(len(own)), [len(c) for c in own])
    keep = count[at] > 1
    # The centres of each set, one after the other; each begins with one, number n, that no set has.
    row, number = np.append(np.arange(len(own)), row[keep]), np.append(np.full(len(own), n), number[at[keep]])
    order = np.argsort(row, kind="stable")
    row, number = row[order], number[order]
    starts = np.searchsorted(row, np.arange(len(own) + 1))

    def rows(who: np.ndarray) -> np.ndarray:
        has = np.zeros((len(who), n + 1), bool)
        for i, w in enumerate(who):
            has[i, number[starts[w] + 1 : starts[w + 1]]] = True
        return np.logical_or.reduceat(has[:, number], starts[:-1], axis=1)

    return rows


def met_before(centres: list[np.ndarray], centre: int) -> np.ndarray | None:
    """Which sets have a smaller centre in common, where they meet too; None if no two have."""
    rows = meetings(centres, centre)
    return None if rows is None else rows(np.arange(len(centres)))


def _join_buckets(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of every (centre, i, j) in the group: spanning edges and link counts.

    A pair that meets in several buckets counts in the smallest common centre's.
    """
    rows = []
    for (centre, i, j), part in pdf.groupby(["centre", "i", "j"], sort=False):
        part = part.drop_duplicates("cls").reset_index(drop=True)
        sets = [pickle.loads(g) for g in part["grams"]]
        met = meetings([np.asarray(c, np.int64) for c in part["centres"]], centre)
        every = np.arange(len(part))
        a, b = (every, every) if i == j else (every[part["own"] == i], every[part["own"] == j])
        block, before = -1, None  # of the probes, and where they have met all sets
        root, links, copies = every.copy(), np.zeros(len(part), np.int64), part["copies"].to_numpy(np.int64)
        for who, y in linked([sets[x] for x in a], None if i == j else [sets[x] for x in b], percent):
            if met is not None:
                if who[0] // PROBES != block:
                    block = who[0] // PROBES
                    before = met(a[block * PROBES :][:PROBES])
                who = who[~before[who - block * PROBES, b[y]]]
            who, y = a[who], b[y]
            links[who] += copies[y]
            links[y] += copies[who].sum()
            roots = np.unique(root[np.append(who, y)])
            if len(roots) > 1:
                root[np.isin(root, roots[1:])] = roots[0]
        rows += [(int(part["rep"][x]), int(part["rep"][root[x]]), part["cls"][x], int(links[x])) for x in np.flatnonzero(links)]
    return _frame(rows, LINKS)


# --- the operator --------------------------------------------------------------------------


def join(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), n_links."""
    slots = groups_for(spark, docs, text)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    answers = _send(slim, slots, words).groupBy("slot").applyInPandas(_shared, "block string, kind int, data binary")
    table = answers.groupBy("block").applyInPandas(_per_document, "doc_id long, n_shingles long, cls string, shared long")
    table = written(spark, table, "ngram-documents")
    classes = table.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n"), F.max("shared").alias("shared")
    )
    classes = written(spark, classes, "ngram-classes")
    hopeful = written(spark, classes.where(100 * F.col("shared") >= percent * F.col("n")).select(F.col("rep").alias("doc_id"), "cls", "copies", "rep"), "ngram-hopeful")
    sets = _survivor_sets(slim, hopeful, words).join(hopeful, ["doc_id", "cls"])  # an id may be on several rows
    sets = written(spark, sets.select("cls", "n", "copies", "rep", "block", "grams"), "ngram-sets")

    asked = sets.select("block", "cls", "n", "grams").groupBy("block").applyInPandas(lambda pdf: _ask(pdf, slots), PACKED)
    told = asked.groupBy("slot").applyInPandas(_tell, PACKED)
    own = sets.select("block", "cls", "n", "grams").groupBy("block")
    near = own.cogroup(told.groupBy("block")).applyInPandas(lambda a, b: _centres(a, b, slots, percent), NEAR)
    near = written(spark, near.dropDuplicates(["cls"]), "ngram-centres")
    members = near.select("cls", "n", F.explode("centres").alias("centre"))
    buckets = members.groupBy("centre").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("grams")).where("m > 1")
    buckets = written(spark, buckets.select("centre", F.ceil(F.col("grams") / BUCKET).cast("int").alias("blocks")), "ngram-buckets")
    # Each member goes to the pairs of blocks that its own block is in.
    dealt = members.select("cls", "centre").join(buckets, "centre").withColumn("own", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cls", "centre", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    tasks = dealt.join(near.select("cls", "centres", "grams"), "cls").join(hopeful.select("cls", "copies", "rep"), "cls")
    tasks = tasks.withColumn("task", F.pmod(F.xxhash64("centre", "i", "j"), F.lit(8 * shuffle_partitions(spark))))
    links = tasks.groupBy("task").applyInPandas(lambda pdf: _join_buckets(pdf, percent), LINKS)
    links = written(spark, links, "ngram-links")

    # Texts of one id belong together: the id is linked with the first id of each of its classes.
    several = table.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least <> most").select("doc_id")
    several = written(spark, several, "ngram-several")
    own = table.where("n_shingles > 0").join(several, "doc_id", "left_semi").select("doc_id", "cls").distinct().join(classes.select("cls", "rep"), "cls")
    found = components(spark, links.select(F.col("rep").alias("u"), F.col("root").alias("v")).unionByName(own.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))))
    several = several.join(found, several["doc_id"] == found["node"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("together"))
    counts = links.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.select("cls", "rep", "copies").join(found, classes["rep"] == found["node"], "left").join(counts, "cls", "left")
    known = known.select("cls", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    # A class may be a third of all documents: both sides are salted.
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    out = table.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(salted, ["cls", "salt"], "left")
    out = out.join(several, "doc_id", "left")
    taking_part = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return out.select(
        "doc_id", "n_shingles",
        F.coalesce("together", F.when(taking_part, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id"),
        F.when(taking_part, F.col("links")).otherwise(F.lit(0)).alias("n_links"),
    )


def one_of_each(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the document of the smallest id of each component, all columns.

    Rows without an id stay; of rows that repeat a kept id all stay.
    """
    gone = join(spark, docs, text, doc_id, words, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = written(spark, gone, "ngram-gone")
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")
