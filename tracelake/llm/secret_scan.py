"""Secret scans: pattern rules plus sliding-window Shannon entropy.

One pass over the texts, no shuffle. The rules find assignments, access keys
and long hex strings. Beyond them, every run of key-like characters is a
candidate: a window slides over it, character counts are kept incrementally
and a window counts as secret if its entropy reaches the limit of the
candidate's character class. Allow-listed candidates are suppressed, and of
others the parts that hold an example word. What a pattern rule covers of an
entropy span is not reported again.

Defined results: a null text is an empty one and yields no spans; repeated
rows are scanned each on their own; a null id is kept; spans that start at one
place are ordered by kind; an empty table gives no rows; further columns are left out; very long
texts are scanned whole, memory is that of one batch of rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import forget_kept

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
#: Greedy runs, so a minimum length in the pattern drops what fails it.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Without one of these in the lower-cased text ASSIGN can't match.
WORDS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class EntropyClass:
    """Candidates of these characters: window width and least bits per character."""

    name: str
    pattern: str
    window: int
    bits: float


#: A candidate belongs to the first class that has all its characters. Words
#: of natural language stay below these limits; random strings reach them.
CLASSES = (
    EntropyClass("digits", r"[0-9]+", 24, 2.8),
    EntropyClass("hex", r"[0-9a-fA-F]+", 24, 3.0),
    EntropyClass("letters", r"[A-Za-z]+", 24, 4.0),
    EntropyClass("alnum", r"[A-Za-z0-9]+", 24, 3.9),
    EntropyClass("base64", r"[A-Za-z0-9+/_=-]+", 24, 4.0),
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
#: Well-known strings that are no secrets: UUIDs and rulers.
ALLOW = (
    r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}",
    r"[-=_+/]+",
)
#: Parts of candidates, between separators, that are no secrets: example keys, alphabets.
EXAMPLE = re.compile(r"(?i)[0-9a-z]*(?:example|placeholder|changeme|xxxxxx|000000|123456789|abcdefghi)[0-9a-z]*")
#: Paths of plain words, in single case or camel case. Random letters have
#: single ones between others of the other case.
PATH = re.compile(r"(?:[-/_=+]*(?:[a-z]|[A-Z]|(?:[A-Z]?[a-z]{2,}|[A-Z]{2,})+)(?![A-Za-z]))+[-/_=+]*")

SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, "
    "base_sha256 string, spans string"
)


def entropy_spans(text: str, classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> list[tuple[int, int]]:
    """Spans of candidates whose windows reach their class's entropy limit.

    Overlapping and adjacent windows form one span; ends are exclusive.
    """
    found = []
    for m in CANDIDATE.finditer(text):
        if any(re.fullmatch(p, m.group()) for p in allow):
            continue
        for start, run in outside_examples(m.group()):
            kind = next(c for c in classes if re.fullmatch(c.pattern, run))
            # A word is plain only if it is of low entropy; so letters that are one word must reach their class's limit, as others.
            if kind.name != "letters" and PATH.fullmatch(run):
                letters = next((c for c in classes if c.name == "letters"), None)
                words = [(start + w.start(), w.group(), letters) for w in re.finditer("[A-Za-z]+", run)] if letters else []
            else:
                words = [(start, run, kind)]
            for at, word, c in words:
                if len(word) >= c.window:
                    found += [(m.start() + at + a, m.start() + at + b) for a, b in dense_windows(word, c.window, c.bits)]
    return found


def outside_examples(run: str) -> list[tuple[int, str]]:
    """(start, string) of what a candidate has beside its example parts."""
    out, at = [], 0
    for e in EXAMPLE.finditer(run):
        out.append((at, run[at : e.start()]))
        at = e.end()
    return [(a, x) for a, x in [*out, (at, run[at:])] if x]


def dense_windows(run: str, width: int, bits: float) -> list[tuple[int, int]]:
    """Merged windows of ``width`` whose Shannon entropy is at least ``bits``."""
    weight = [0.0] + [c * math.log2(c) for c in range(1, width + 2)]
    counts: dict[str, int] = {}
    total, spans = 0.0, []  # total: sum of c * log2(c)
    for end, ch in enumerate(run, 1):
        c = counts[ch] = counts.get(ch, 0) + 1
        total += weight[c] - weight[c - 1]
        if end > width:
            gone = run[end - width - 1]
            c = counts[gone] = counts[gone] - 1
            total += weight[c] - weight[c + 1]
        if end >= width and math.log2(width) - total / width >= bits - 1e-9:
            if spans and end - width <= spans[-1][1]:
                spans[-1][1] = end
            else:
                spans.append([end - width, end])
    return [(a, b) for a, b in spans]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern rules, sorted."""
    spans = []
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and these with the parts of entropy spans that none of them covers."""
    base, added, covered = base_spans(text), [], []
    for s, _, e in base:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    first = 0
    for a, b in sorted(entropy_spans(text)):
        while first < len(covered) and covered[first][1] <= a:
            first += 1
        at = first
        while a < b and at < len(covered) and covered[at][0] < b:
            if a < covered[at][0]:
                added.append((a, 3, covered[at][0]))
            a, at = max(a, covered[at][1]), at + 1
        if a < b:
            added.append((a, 3, b))
    return base, sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: counts by kind, digest of the base spans, all spans."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for key, value in zip(pdf["doc_id"].array, pdf["text"].array, strict=True):
                base, every = all_spans(value)
                n = [sum(k == kind for _, k, _ in every) for kind in range(4)]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((key, *n, digest, joined(every)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.mapInPandas(batches, SCHEMA)


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``[KIND]``; null texts stay null."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        forget_kept()
        return texts.map(lambda t: None if t is None else masked_text(t))

    return docs.withColumn(text, masked(F.col(text)))


def masked_text(text: str) -> str:
    """Spans become ``[KIND]``; overlapping spans become one, named by the first."""
    merged: list[list[int]] = []
    for s, k, e in all_spans(text)[1]:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    out, at = [], 0
    for s, k, e in merged:
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])
