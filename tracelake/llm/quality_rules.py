"""Quality rules: document counts and cross-document line frequency.

Every document gets counts of words, symbols, repeated lines and repeated
eight-word windows; two of them are limits of their own. Then lines are
normalised and hashed, and for each host the distinct documents that carry a
line are counted. Lines above the host's limit are boilerplate: they are
removed, and a document that keeps too little of its words is rejected.

Defined results: a null text is an empty one (no words, base_failed); a null
host is a host of its own; every row is a document, with or without an id, so
repeated rows count each and are judged each on their own; a line that a
document has several times counts once; nothing is ordered, so ties don't
matter; further columns are left out; an empty table gives no rows; texts are read
whole however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import WordHashes, windows, written

WINDOW = 8
#: A line is boilerplate in a host if more documents than both carry it.
LINE_DOCS, LINE_SHARE = 10, 0.05
#: A document is depleted if it keeps less than this share of its words.
KEEP_SHARE = 0.2
SALTS = 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point

COLUMNS = (
    "doc_id long, host string, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<long>"
)


def repeated_words(hashes: np.ndarray, words: list[bytes], k: int = WINDOW) -> int:
    """Words in windows of k words that occur twice or more in the text.

    Equal hashes point to windows; where there are any, windows are compared
    exactly, by ranks of ever longer runs.
    """
    h = windows(hashes, k)
    if len(h) < 2:
        return 0
    ordered = np.sort(h)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    ids, ranks = {}, None
    ranks = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    width = 1
    while width < k:
        step = min(width, k - width)
        pairs = ranks[: len(ranks) - step] * (int(ranks.max()) + 1) + ranks[step:]
        ranks = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        width += step
    twice = np.bincount(ranks)[ranks] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:-k] += twice
    edge[k:] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def line_hash(line: bytes) -> int:
    """64 bits of the line in lower case (A-Z) with single spaces."""
    h = xxhash.xxh3_64_intdigest(b" ".join(line.lower().split()))
    return h - 2**64 if h >= 2**63 else h


def counted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source") -> DataFrame:
    """One row for each document: its counts and its distinct lines with their words."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes.kept()
        for pdf in frames:
            rows = []
            for key, at, value in zip(pdf["doc_id"].array, pdf["host"].array, pdf["text"].array, strict=True):
                raw = value.encode("utf-8", "surrogatepass")
                codes = np.frombuffer(raw, np.uint8)
                words = raw.split()
                seen: set[bytes] = set()
                lines: dict[int, int] = {}
                dup = 0
                for line in raw.split(b"\n"):
                    if n := len(line.split()):
                        dup += line in seen
                        seen.add(line)
                        h = line_hash(line)
                        lines[h] = lines.get(h, 0) + n
                rows.append((
                    key, at, len(words), int(_LEAD[codes].sum() - _SPACE[codes].sum()), int(_SYMBOL[codes].sum()),
                    dup, repeated_words(known.of(words), words), list(lines), list(lines.values()),
                ))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")]).astype({"doc_id": "Int64"})

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.mapInPandas(batches, COLUMNS)


def boilerplate(table: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """host_key, line: lines that too many distinct documents of the host carry.

    At most (lines of a document on average / line_share) rows a host.
    """
    per_host = table.groupBy("host_key").agg(F.count(F.lit(1)).alias("host_docs"))
    lines = table.select("host_key", F.explode("lines").alias("line"))
    counts = lines.groupBy("host_key", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > line_docs)
    return counts.join(per_host, "host_key").where(F.col("n") > line_share * F.col("host_docs")).select("host_key", "line")


def judged(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, keep_share: float = KEEP_SHARE) -> DataFrame:
    """doc_id, the counts, n_removed_words, base_failed, kept."""
    key = F.when(F.col("host").isNull(), "0").otherwise(F.concat(F.lit("1"), "host"))
    table = counted(docs, text, doc_id, host).withColumn("host_key", key).withColumn("row", F.monotonically_increasing_id())
    table = written(spark, table, "rules-lines")
    common = written(spark, boilerplate(table, line_docs, line_share), "rules-boilerplate")
    # A frequent line is a hot key; both sides are salted.
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    own = table.select("row", "host_key", salt.alias("salt"), F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    own = own.select("row", "host_key", "salt", F.col("l.lines").alias("line"), F.col("l.line_words").alias("n"))
    salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    removed = own.join(salted, ["host_key", "line", "salt"]).groupBy("row").agg(F.sum("n").alias("n_removed_words"))
    out = table.drop("lines", "line_words").join(removed, "row", "left").fillna(0, ["n_removed_words"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed_words") < keep_share * F.col("n_words")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
    )


def cleaned(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """``docs`` with boilerplate lines taken out of their texts.

    The lines of a host travel to its documents as one list, bounded by
    (lines of a document on average / line_share).
    """
    key = F.when(F.col("host").isNull(), "0").otherwise(F.concat(F.lit("1"), "host"))
    table = counted(docs, text, doc_id, host).withColumn("host_key", key).withColumn("row", F.monotonically_increasing_id())
    common = written(spark, boilerplate(written(spark, table, "rules-lines"), line_docs, line_share), "rules-boilerplate")
    lists = common.groupBy("host_key").agg(F.collect_list("line").alias("_lines"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, lines: pd.Series) -> pd.Series:
        out = []
        for t, gone in zip(texts.array, lines.array, strict=True):
            gone = set() if gone is None else set(gone)
            out.append(t if t is None or not gone else "\n".join(x for x in t.split("\n") if not x.split() or line_hash(x.encode()) not in gone))
        return pd.Series(out, dtype=object)

    rows = docs.select(F.struct("*").alias("row"))  # one column, whatever the names in it
    own = F.when(F.col(f"row.{host}").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(f"row.{host}").cast("string")))
    joined = rows.withColumn("host_key", own).join(lists, "host_key", "left")
    new = without(F.col(f"row.{text}"), F.col("_lines"))
    return joined.select(*(new.alias(c) if c == text else F.col(f"row.{c}") for c in docs.columns))
