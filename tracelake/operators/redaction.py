"""From findings to redacted texts: a user's allow-list, merging, and one pass over each text.

Findings: ``doc_id``, ``field`` (may be missing), ``entity``, ``entity_type``,
``confidence``. All entities of a text are looked for by one automaton, in one
pass, whatever their number.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What stands for an entity of a type.
PLACEHOLDERS = {
    "person_name": "[REDACTED_NAME]", "email": "[REDACTED_EMAIL]", "phone": "[REDACTED_PHONE]", "username": "[REDACTED_USERNAME]", "user_id": "[REDACTED_USER_ID]",
    "org_name": "[REDACTED_ORG]", "project_name": "[REDACTED_PROJECT]", "private_url": "[REDACTED_URL]", "domain": "[REDACTED_DOMAIN]", "address": "[REDACTED_ADDRESS]",
    "location": "[REDACTED_LOCATION]", "bot_name": "[REDACTED_BOT]", "device_id": "[REDACTED_DEVICE_ID]", "path": "[REDACTED_PATH]", "custom_sensitive": "[REDACTED]",
}
OTHER = "[REDACTED]"
#: Shorter entities are never replaced.
LEAST = 3


def without_allowed(findings: DataFrame, exact: Iterable[str] = (), categories: Iterable[str] = (), patterns: Iterable[str] = ()) -> DataFrame:
    """Findings that a user's list doesn't allow: by text, by type, or by a pattern that occurs in them.

    The list is one user's settings, a few entries; patterns that don't
    compile allow nothing.
    """
    sound = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        if p:
            sound.append(p)
    free = F.col("entity").isin(*exact) | F.col("entity_type").isin(*categories)
    for p in sound:
        free = free | F.col("entity").rlike(p)
    return findings.where(~F.coalesce(free, F.lit(False)))


def inside_others(entities: list[str]) -> set[str]:
    """Of distinct texts, those that occur in another one: one automaton, one pass over each."""
    automaton = ahocorasick.Automaton()
    for e in entities:
        automaton.add_word(e, e)
    automaton.make_automaton()
    return {found for e in entities for _, found in automaton.iter(e) if found != e}


def merged(findings: DataFrame, least: float = 0.0) -> DataFrame:
    """Of each document's and field's findings those whose entity is in no longer one, whatever its case; of equal ones the surest.

    A group is the findings of one text.
    """
    rows = findings if "field" in findings.columns else findings.withColumn("field", F.lit("content"))
    rows = rows.where((F.col("entity") != "") & (F.col("confidence") >= least)).withColumn("_lower", F.lower("entity"))
    order = F.struct((-F.col("confidence")).alias("c"), "entity_type", "entity")
    each = rows.groupBy("doc_id", "field", "_lower").agg(F.min_by(F.struct("entity", "entity_type", "confidence"), order).alias("f"))
    groups = each.groupBy("doc_id", "field").agg(F.collect_list("_lower").alias("lower"), F.collect_list("f").alias("found"))

    @F.pandas_udf("array<string>")
    def dropped(lower: pd.Series) -> pd.Series:
        return lower.map(lambda x: sorted(inside_others(list(x))))

    kept = groups.withColumn("gone", F.when(F.size("lower") > 1, dropped("lower"))).withColumn("f", F.explode("found"))
    kept = kept.where(F.col("gone").isNull() | ~F.array_contains("gone", F.lower("f.entity")))
    return kept.select("doc_id", "field", "f.entity", "f.entity_type", "f.confidence")


def lowered(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def apply(text: str, findings: list[tuple[str, str, float]]) -> tuple[str, int]:
    """(the text with all whole-word occurrences of the entities replaced, how many), longer ones first.

    findings: (entity, type, confidence). The result is that of replacing one
    entity after the other: what is replaced is no part of later matches, and
    next to it a word begins or ends.
    """
    wanted: dict[str, tuple] = {}
    for rank, (entity, kind, _) in enumerate(sorted(findings, key=lambda f: (-len(f[0]), -f[2]))):
        if len(entity) >= LEAST:
            wanted.setdefault(lowered(entity), (rank, len(entity), PLACEHOLDERS.get(kind, OTHER)))
    if not wanted or not text:
        return text, 0
    automaton = ahocorasick.Automaton()
    for entity, what in wanted.items():
        automaton.add_word(entity, what)
    automaton.make_automaton()
    found = sorted((rank, last - size + 1, last + 1, mask) for last, (rank, size, mask) in automaton.iter(lowered(text)))
    starts: list[int] = []
    ends: list[int] = []
    masks: list[str] = []
    for _, a, b, mask in found:
        at = bisect_left(starts, b)
        if at and ends[at - 1] > a:
            continue
        before = a > 0 and not (at and ends[at - 1] == a) and is_word(text[a - 1])
        after = b < len(text) and not (bisect_right(starts, b) > at and starts[at] == b) and is_word(text[b])
        if not before and not after:
            starts.insert(at, a)
            ends.insert(at, b)
            masks.insert(at, mask)
    pieces, last = [], 0
    for a, b, mask in zip(starts, ends, masks, strict=True):
        pieces += [text[last:a], mask]
        last = b
    return "".join([*pieces, text[last:]]), len(starts)


def redacted(docs: DataFrame, findings: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the entities of their findings replaced, and ``n_redacted``; texts without findings are not sent to Python."""
    own = findings.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("entity", F.coalesce("entity_type", F.lit("")).alias("entity_type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))).alias("_f"))

    @F.pandas_udf("struct<text: string, n: int>")
    def replaced(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = [apply(t, [(f["entity"], f["entity_type"], f["confidence"]) for f in fs]) for t, fs in zip(texts, found, strict=True)]
        return pd.DataFrame(out, columns=["text", "n"])

    joined = docs.join(own, docs[doc_id] == own["_id"], "left").drop("_id")
    done = joined.withColumn("_r", F.when(F.col("_f").isNotNull() & F.col(text).isNotNull(), replaced(F.coalesce(text, F.lit("")), F.coalesce("_f", F.expr("CAST(array() AS array<struct<entity: string, entity_type: string, confidence: double>>)")))))
    return done.withColumn(text, F.coalesce("_r.text", text)).withColumn("n_redacted", F.coalesce("_r.n", F.lit(0))).drop("_f", "_r")


def until_clean(docs: DataFrame, scan: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, str], DataFrame], passes: int = 3) -> tuple[DataFrame, DataFrame]:
    """(texts, findings that are left) after scanning and masking until a scan finds nothing new, ``passes`` times at most.

    scan(docs) gives findings; write(df, name) stores a table and reads it
    back, so that each pass starts from what the last one wrote. Only texts
    that changed are scanned again. Documents with findings left didn't
    converge: their masking uncovers something anew each time.
    """
    docs = write(docs.withColumn("_open", F.lit(True)), "pass-0")
    for n in range(1, passes + 1):
        found = write(merged(scan(docs.where("_open"))), f"found-{n}")
        if found.isEmpty():
            return docs.drop("_open"), found
        masked = redacted(docs, found)
        docs = write(masked.withColumn("_open", F.col("n_redacted") > 0).drop("n_redacted"), f"pass-{n}")
    return docs.drop("_open"), write(merged(scan(docs.where("_open"))), "left")
