"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents longer than a sequence are cut; all pieces are packed by best fit in
bulk-synchronous rounds. Pieces and gaps are kept as runs (pieces of one
length with their ranks, sequences with equal gaps), sorted into ranges of
sizes. In a round every run of pieces goes to the range of its smallest
possible gap; each range is swept on its own, longest pieces first, each to
the successor among the gaps of the range; conflicts between pieces are
settled by rank. Gaps are updated and sorted again, and rounds repeat until
no piece has a gap that holds it; then the longest range of what is left opens
new sequences and the rounds go on.

Runs are bounded by the sequence length, not by the corpus, so rounds move
little. All work on pieces (tokenising, ranking, looking up a rank's run) is
distributed; no length, however frequent, is ranked in one task.

Defined results: a null text is an empty one, which is the end token alone;
equal rows are packed each on their own; pieces of one length are ranked by a
hash of doc_id, piece and content, then by doc_id (null first) and piece, and
such as are equal in all of these may swap places; a null doc_id is packed
like any other; an empty table gives no rows; further columns are left out;
a text of any length is tokenised whole and cut into pieces by its tokens.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import kept_in_worker, mixed, rank_in_groups, written

SEQUENCE = 4096
END = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Runs of pieces (ranks low to high - 1), of gaps (sequences first to first + n - 1), segments that are placed.
RUNS = "cell int, kind string, size long, low long, high long, first long, per long, base long"
#: Ranges of sizes: each begins at half of the one before, the last at 1.
CELLS = 6


class Encoder:
    """Token ids of texts, as little-endian bytes; words are remembered.

    The tokenizer splits at white space and never joins across it. A chunk of
    plain characters between spaces falls into words as the tokenizer's own
    rule has it (letters, single digits, other signs), in lower case; other
    chunks are words as they are. Words of a batch of texts are found with
    array operations. Those of up to 16 plain characters are two whole
    numbers, looked up among the known ones; all unknown words of the batch
    are tokenised at once.

    When there are too many, the words not used for longest are forgotten.
    """

    WORDS = 300_000
    #: Characters of texts that make a batch.
    BATCH = 1_000_000
    #: Character classes: 1 space, 2 letter, 3 digit, 4 sign; 0 for those whose words
    #: are left whole: apostrophes and all that normalisation may change.
    KINDS = np.zeros(257, np.uint8)
    KINDS[[0x20, 0x09, 0x0A, 0x0D]] = 1
    KINDS[[*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = 2
    KINDS[48:58] = 3
    KINDS[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 4
    LOWER = np.arange(257).astype(np.uint8)
    LOWER[[*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]] += 32
    #: The first n bytes of a whole number.
    FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clock = 0  # batches so far
        self._remember(*(np.empty(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int32, np.int32, np.int32, "<u4")))

    def _remember(self, key: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, n: np.ndarray, used: np.ndarray, pool: np.ndarray) -> None:
        """Known words: sorted keys, their characters, where their ids are in the pool, and the batch of their last use."""
        self.key, self.low, self.high, self.start, self.n, self.used, self.pool = key, low, high, start, n, used, pool

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker process and file."""
        return kept_in_worker(f"encoder {path}", lambda: cls(path))

    def __call__(self, text: str) -> bytes:
        return self.batch([text])[0]

    def batches(self, texts: Sequence[str]) -> Iterator[bytes]:
        """The ids of each text; texts are taken together up to BATCH characters."""
        first, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= self.BATCH:
                yield from self.batch(texts[first : i + 1])
                first, size = i + 1, 0
        yield from self.batch(texts[first:])

    def batch(self, texts: Sequence[str]) -> list[bytes]:
        whole = " ".join(texts) + " "
        small = np.minimum(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4"), 256).astype(np.uint16)
        low = np.concatenate([self.LOWER[small], np.zeros(16, np.uint8)])
        starts, ends, plain = self._words(small, low)
        eight = np.ndarray((len(low) - 7,), "<u8", buffer=low, strides=(1,))  # the eight characters from each place on
        length = ends - starts
        first = eight[starts] & self.FIRST[np.minimum(length, 8)]
        second = eight[np.minimum(starts + 8, len(eight) - 1)] & self.FIRST[np.clip(length - 8, 0, 8)]
        key = mixed(first * np.uint64(0x9E3779B97F4A7C15) ^ second)
        short = np.flatnonzero(plain & (length <= 16))
        at, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        distinct, one, which = np.unique(key[short], return_index=True, return_inverse=True)
        one = short[one]
        # Equal keys of unequal words, if that happens, are tokenised one by one.
        same = (first[short] == first[one][which]) & (second[short] == second[one][which])
        self._learn(distinct, first[one], second[one])
        found = np.searchsorted(self.key, distinct)
        same &= ((self.low[found] == first[one]) & (self.high[found] == second[one]))[which] if len(found) else same
        at[short[same]], n[short[same]] = self.start[found][which[same]], self.n[found][which[same]]
        singly = np.ones(len(starts), bool)
        singly[short[same]] = False
        pool = [self.pool]
        if singly.any():
            rows = np.flatnonzero(singly)
            words = [whole[a:b] for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)]
            number = {w: i for i, w in enumerate(dict.fromkeys(words))}
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(list(number), add_special_tokens=False)]
            sizes = np.array([len(x) for x in ids], np.int64)
            which = np.array([number[w] for w in words], np.int64)
            at[rows], n[rows] = len(self.pool) + (np.cumsum(sizes) - sizes)[which], sizes[which]
            pool.append(np.array([x for own in ids for x in own], "<u4"))
        place = np.cumsum(n) - n
        ids = np.concatenate(pool)[np.repeat(at - place, n) + np.arange(int(n.sum()))]
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = np.append(place, len(ids))[np.searchsorted(starts, begin)]
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def _words(self, small: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, whether plain) of all words."""
        kind = self.KINDS[small]
        space = kind == 1
        odd = kind == 0
        odd[:-1] |= (low[: len(kind) - 1] == 0x3C) & (low[1 : len(kind)] == 0x7C)  # "<|": may begin a special token
        chunk = np.cumsum(space, dtype=np.int32)
        left_whole = np.zeros(int(chunk[-1]) + 1, bool)
        left_whole[chunk[odd & ~space]] = True
        left_whole = left_whole[chunk]
        start = ~space
        start[1:] &= space[:-1] | (~left_whole[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 3)))
        starts = np.flatnonzero(start)
        ends = np.flatnonzero(~space & np.append(start[1:] | space[1:], True)) + 1
        return starts, ends, ~left_whole[starts]

    def _learn(self, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Tokenises the words that are not known yet. ``key`` is sorted."""
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        new = self.key[at] != key if len(self.key) else np.ones(len(key), bool)
        self.clock += 1
        self.used[at[~new]] = self.clock
        if not new.any():
            return
        low, high = low[new], high[new]
        words = [w.decode("latin-1") for w in np.column_stack([low, high]).view("S16").ravel().tolist()]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            each = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
        start = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        old = np.arange(len(self.key))
        if len(old) + len(words) > self.WORDS:
            kept = int((self.used == self.clock).sum())
            kept = max(kept, self.WORDS // 2 - len(words))
            old = np.sort(np.argsort(-self.used, kind="stable")[:kept])
        n = self.n[old]
        place = np.cumsum(n) - n
        pool = self.pool[np.repeat(self.start[old] - place, n) + np.arange(int(n.sum()))]
        every = np.concatenate([self.key[old], key[new]])
        order = np.argsort(every, kind="stable")
        both = lambda a, b: np.concatenate([a, b])[order]
        self._remember(
            every[order], both(self.low[old], low), both(self.high[old], high), both(place.astype(np.int32), (start + len(pool)).astype(np.int32)),
            both(n, (ends - start).astype(np.int32)), both(self.used[old], np.full(len(words), self.clock, np.int32)), np.concatenate([pool, ids]),
        )


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", length: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """One row for each piece; with keep_ids also ``ids`` (binary, little-endian)."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = Encoder.of(tokenizer), np.array([END], "<u4").tobytes()
        for pdf in frames:
            rows = []
            for key, ids in zip(pdf["doc_id"].array, encode.batches(pdf["text"].tolist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part), part)[: 5 + keep_ids])
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.mapInPandas(batches, PIECES + ", ids binary" * keep_ids)


def sweep(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int, opened: int | None = None) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Best fit of piece runs (length, low, high) into gap runs (gap, first, n), longest pieces first.

    With ``opened``, the number of sequences so far, pieces without a gap open
    new ones. Gives segments (length, low, high, first, per, base): ranks low
    to high - 1 go to the sequences from ``first`` on, ``per`` to each, behind
    ``base`` tokens; then the pieces and gaps left, and the sequences opened.
    """
    sizes: list[int] = []  # gaps that runs have, sorted
    runs: dict[int, list[tuple[int, int]]] = {}
    segments, left, new = [], [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                insort(sizes, gap)
            runs[gap].append((first, n))

    for run in sorted(gaps, reverse=True):
        put(*run)
    for length, low, high in sorted(pieces, key=lambda r: (-r[0], r[1])):
        while low < high:
            j = bisect_left(sizes, length)
            if j < len(sizes):
                gap = sizes[j]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], sizes[j]
            elif opened is not None:
                gap, first = capacity, opened + new
                n = -(-(high - low) // (capacity // length))
                new += n
            else:
                left.append((length, low, high))
                break
            per = gap // length
            placed = min(high - low, n * per)
            full, some = divmod(placed, per)
            segments.append((length, low, low + placed, first, per, capacity - gap))
            put(gap - per * length, first, full)
            put(gap - some * length, first + full, 1 if some else 0)
            put(gap, first + full + (some > 0), n - full - (some > 0))
            low += placed
    return segments, left, [(gap, first, n) for gap, own in runs.items() for first, n in own], new


def _sweeper(capacity: int, opened: int | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Sweeps a range; range CELLS opens sequences from number ``opened`` on."""
    return lambda pdf: _swept(pdf, capacity, opened if pdf["cell"].iloc[0] == CELLS else None)


def _swept(pdf: pd.DataFrame, capacity: int, opened: int | None) -> pd.DataFrame:
    """A range's sweep: segments, and the runs left."""
    of = lambda kind, *columns: list(pdf.loc[pdf["kind"] == kind, list(columns)].astype("int64").itertuples(index=False, name=None))
    segments, left, gaps, new = sweep(of("piece", "size", "low", "high"), of("gap", "size", "first", "per"), capacity, opened)
    rows = [(0, "segment", *s) for s in segments] + [(0, "piece", *p, 0, 0, 0) for p in left] + [(0, "gap", g, 0, 0, first, n, 0) for g, first, n in gaps]
    return pd.DataFrame([*rows, (0, "opened", new, 0, 0, 0, 0, 0)], columns=[c.split()[0] for c in RUNS.split(", ")])


def rounds(spark: SparkSession, lengths: DataFrame, capacity: int) -> DataFrame:
    """size, low, high, first, per, base: the places of all ranks. ``lengths``: length, n."""
    size = F.col("size")
    cell = sum(((size <= capacity >> i).cast("int") for i in range(1, CELLS)), F.lit(0))
    zero = F.lit(0).cast("long")
    state = lengths.select(F.lit("piece").alias("kind"), F.col("length").alias("size"), zero.alias("low"), F.col("n").alias("high"), zero.alias("first"), zero.alias("per"), zero.alias("base"))
    placed, opened = [], 0
    while True:
        # Of each range only its largest gap and its longest piece come to the driver.
        largest = {(r["kind"], r["cell"]): r["most"] for r in state.groupBy("kind", cell.alias("cell")).agg(F.max("size").alias("most")).collect()}
        waiting = [c for kind, c in largest if kind == "piece"]
        if not waiting:
            break
        target, fits = F.lit(-1), False
        for c in range(CELLS):  # the smallest range at or above the piece's own with a gap that holds it
            if (most := largest.get(("gap", c))) is not None:
                target = F.when((cell >= c) & (size <= most), c).otherwise(target)
                fits = fits or any(p >= c and low_of(p, capacity) <= most for p in waiting)
        moved = state.withColumn("cell", F.when(F.col("kind") == "piece", target).otherwise(cell).cast("int"))
        if fits:
            fits = not moved.where("kind = 'piece' AND cell >= 0").isEmpty()
        if not fits:
            moved = moved.withColumn("cell", F.when((F.col("kind") == "piece") & (cell == min(waiting)), CELLS).otherwise(F.col("cell")).cast("int"))
        number = None if fits else opened
        swept = moved.select(*(c.split()[0] for c in RUNS.split(", "))).groupBy("cell").applyInPandas(_sweeper(capacity, number), RUNS)
        swept = written(spark, swept, "pack-round")
        placed.append(swept.where("kind = 'segment'"))
        opened += swept.where("kind = 'opened'").agg(F.sum("size")).first()[0]
        state = swept.where("kind IN ('piece', 'gap')")
    columns = ["size", "low", "high", "first", "per", "base"]
    return reduce(DataFrame.unionAll, placed, state.limit(0)).select(*columns)


def low_of(cell: int, capacity: int) -> int:
    """The least size in a range."""
    return (capacity >> (cell + 1)) + 1 if cell < CELLS - 1 else 1


def pack(spark: SparkSession, cut: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """``cut`` (a written table of pieces) with sequence_id and offset."""
    lengths = written(spark, cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "pack-lengths")  # capacity rows at most
    segments = written(spark, rounds(spark, lengths, capacity).withColumnRenamed("size", "length"), "pack-segments")
    # Runs are looked up by blocks of ranks, so that one row meets few of them.
    step = lengths.select("length", F.greatest(F.lit(64), F.ceil(F.col("n") / 4096)).cast("long").alias("step"))
    ranked = rank_in_groups(cut, ["length"], F.xxhash64("doc_id", "piece", "ids_crc32"), [F.col("doc_id"), F.col("piece")], "rank", extra=step)
    blocks = segments.join(step, "length").withColumn("block", F.explode(F.sequence(F.expr("low div step"), F.expr("(high - 1) div step")))).drop("step")
    ranked = ranked.withColumn("block", F.expr("rank div step"))
    placed = ranked.join(blocks, ["length", "block"]).where("rank >= low AND rank < high")
    return placed.select(
        *cut.columns,
        F.expr("first + (rank - low) div per").alias("sequence_id"),
        F.expr("base + ((rank - low) % per) * length").alias("offset"),
    )


def packed_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    return pack(spark, written(spark, pieces(docs, tokenizer, text, doc_id, keep_ids=keep_ids), "pieces"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids: the sequences themselves (pieces need ids)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    return whole.select("sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
