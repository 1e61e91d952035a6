"""Helpers that the operators share: written tables, exact ranks, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    An application's folders lie in one, which is deleted when its JVM ends.
    Where the session names no folder, one is made on a local master (as in
    tests); on a cluster that is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-tracelake-")
        spark.conf.set("spark.checkpoint.dir", root)
    own = f"{root.rstrip('/')}/tracelake-{context.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


_OWN: set[str] = set()


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut."""
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parallel(spark: SparkSession) -> int:
    """Partitions for Python work keyed by hash: as many as shuffles use."""
    return max(8, shuffle_partitions(spark))


def text_size(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def groups_of(spark: SparkSession, size: int, each: int = 64 << 20) -> int:
    """Groups for keyed Python work on all words: one for ``each`` bytes of text, and for each partition at least."""
    return max(2 * parallel(spark), -(-size // each))


def groups_for(spark: SparkSession, docs: DataFrame, text: str, each: int = 64 << 20) -> int:
    return groups_of(spark, text_size(docs, text), each)


def rank_in_groups(df: DataFrame, keys: list[str], hashed: Column, ties: list[Column], out: str, bucket_bits: int = 8, extra: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: gapless ranks from 0 within ``keys`` in the order of (hashed, ties).

    No group is ever sorted in one task: rows are numbered within slices of
    the hash range, and slice counts (2**bucket_bits a group at most) give the
    offsets. ``keys`` must not be null. ``df`` is read twice, so pass a
    written table. Rows equal in everything ordered on may swap ranks; many rows
    with one hash lie in one slice, so where repeated rows are to be split, put
    something that tells them apart into the hash.
    ``extra`` adds its columns by ``keys``; it joins the slices, not the rows,
    so that a frequent key is no hot key of that join.
    """
    df = df.withColumn("_h", hashed).withColumn("_b", F.shiftright("_h", 64 - bucket_bits).cast("int"))
    counts = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    if extra is not None:
        offsets = offsets.join(extra, keys)
    within = Window.partitionBy(*keys, "_b").orderBy("_h", *ties)
    joined = df.join(offsets, [*keys, "_b"])
    return joined.withColumn(out, F.col("_o") + F.row_number().over(within).cast("long") - 1).drop("_h", "_b", "_o")


#: Bits of the largest filter of ids: 16 MB.
FILTER_BITS = 27


def _filter_places(ids: pd.Series, bits: int) -> np.ndarray:
    return (mixed(ids.to_numpy(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def id_filter(ids: DataFrame) -> Callable[[pd.Series], np.ndarray]:
    """For use in tasks: true for all ids of ``ids`` (doc_id, none of them null), and for few others.

    A bit set of hashed ids, 2**FILTER_BITS bits at most, united by chunks. It
    spares a shuffle of the texts that are not needed; what it lets through by
    chance only costs work, as a join decides.
    """
    bits = min(FILTER_BITS, max(12, (16 * ids.count()).bit_length()))

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.zeros(1 << bits >> 3, np.uint8)
        for pdf in frames:
            at = _filter_places(pdf["doc_id"], bits)
            np.bitwise_or.at(whole, at >> 3, (1 << (at & 7)).astype(np.uint8))
        chunks = whole.reshape(-1, min(len(whole), 1 << 13))
        some = np.flatnonzero(chunks.any(axis=1))
        yield pd.DataFrame({"chunk": some, "bits": [chunks[i].tobytes() for i in some]})

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        every = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
        return pd.DataFrame({"chunk": pdf["chunk"][:1], "bits": [every.tobytes()]})

    parts = ids.select("doc_id").mapInPandas(mark, "chunk long, bits binary").groupBy("chunk").applyInPandas(unite, "chunk long, bits binary")
    whole = np.zeros(1 << bits >> 3, np.uint8)
    for r in parts.collect():
        whole[r["chunk"] * len(r["bits"]) :][: len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    marked = ids.sparkSession.sparkContext.broadcast(whole)

    def may_be(own: pd.Series) -> np.ndarray:
        at = _filter_places(own, bits)
        return (marked.value[at >> 3] >> (at & 7) & 1).astype(bool)

    return may_be


_KEPT: dict[str, object] = {}


def kept_in_worker(name: str, make: Callable[[], object]) -> object:
    """An object that a worker process keeps between an operator's tasks.

    There is one at a time: workers serve many operators in turn, and memories
    that only one of them uses would add up.
    """
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def forget_kept() -> None:
    """For operators that keep nothing: what another one has left in this worker goes."""
    _KEPT.clear()


class WordHashes:
    """word bytes -> 64-bit hash.

    Nothing is remembered: a hash takes less time than a look at a table of all
    the words of a corpus, which took some 40 MB in each worker.
    """

    @classmethod
    def kept(cls) -> WordHashes:
        forget_kept()
        return cls()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Odd multipliers without a pattern, one for each place in a window; related
#: ones would give different windows of the same words equal sums.
_ODD = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def windows(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words (none if there are fewer words)."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h += word_hashes[i : i + n] * _ODD[i]
    return mixed(h)


def text_bytes(texts: pd.Series) -> list[bytes | None]:
    return [None if t is None else t.encode("utf-8", "surrogatepass") for t in texts.array]
