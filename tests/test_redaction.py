"""Allow-lists, merging and applying against the rule-by-rule loops; scanning until nothing is found."""

import random
import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.operators import findings as scan
from tracelake.operators import redaction

FOUND = "doc_id long, entity string, entity_type string, confidence double"


def one_by_one(text, found):
    n = 0
    for entity, kind, _ in sorted(found, key=lambda f: (-len(f[0]), -f[2])):
        if len(entity) >= 3:
            text, k = re.subn(rf"(?<!\w){re.escape(entity)}(?!\w)", lambda _, k=kind: redaction.PLACEHOLDERS.get(k, "[REDACTED]"), text, flags=re.IGNORECASE)
            n += k
    return text, n


WORDS = ["Ann", "ann", "Ann Lee", "lee", "@lee", "a.b", "x-y", "x-y-z", "tom@", "b c", "c d", "b c d", "-", "éa", "Éa"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from(["email", "path", "odd"]), st.sampled_from([0.5, 0.9])), max_size=6), st.lists(st.sampled_from([*WORDS, " ", " ", "q", ".", "@", "_"]), max_size=14).map("".join))
def test_one_pass_equals_rule_by_rule(found, text):
    seen, distinct = set(), []
    for f in sorted(found, key=lambda f: (-len(f[0]), -f[2])):
        if f[0].lower() not in seen:
            seen.add(f[0].lower())
            distinct.append(f)
    assert redaction.apply(text, distinct) == one_by_one(text, distinct)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="ab ", min_size=1, max_size=6), max_size=12))
def test_substrings_of_others(entities):
    assert redaction.inside_others(sorted(entities)) == {e for e in entities if any(e != o and e in o for o in entities)}


def test_many_entities_in_a_long_text():
    """Thousands of entities and matches: linear, not their product."""
    rng = random.Random(1)
    names = [f"name{i:05d}" for i in range(5000)]
    text = " ".join(rng.choices([*names, "word"], k=100_000))
    got, n = redaction.apply(text, [(x, "person_name", 1.0) for x in names])
    assert n == sum(w != "word" for w in text.split()) and "name0" not in got
    spans = [(i, i + 1) for i in range(200_000)]
    assert scan.first_claims(spans) == spans


def test_merge_keeps_what_no_other_holds(spark):
    rows = [(1, "Ann Lee", "person_name", 0.8), (1, "ann", "username", 0.9), (1, "ANN LEE", "person_name", 0.9), (1, "tom", "x", 0.2), (2, "ann", "username", 0.9), (2, "", "x", 0.9), (None, "bob", "x", 0.9), (None, "bobby", "x", 0.9)]
    df = spark.createDataFrame(rows, FOUND)
    got = sorted(map(tuple, redaction.merged(df, 0.5).collect()), key=str)
    assert got == sorted([(1, "content", "ANN LEE", "person_name", 0.9), (2, "content", "ann", "username", 0.9), (None, "content", "bobby", "x", 0.9)], key=str)
    assert redaction.merged(df.withColumn("field", F.col("entity"))).count() == 7
    assert redaction.merged(df.limit(0)).count() == 0


def test_allow_list(spark):
    df = spark.createDataFrame([(1, "ann@x.org", "email", 1.0), (1, "Ann@x.org", "email", 1.0), (1, "10.0.0.1", "custom_sensitive", 1.0), (1, "/home/ann", "path", 1.0), (1, None, "path", 1.0)], FOUND)
    kept = lambda **k: [r["entity"] for r in redaction.without_allowed(df, **k).collect()]
    assert kept(exact=["ann@x.org"]) == ["Ann@x.org", "10.0.0.1", "/home/ann", None]
    assert kept(categories=["path"], patterns=["^10[.]", "(broken", ""]) == ["ann@x.org", "Ann@x.org"]
    assert len(kept()) == 5


def test_texts_of_a_table(spark):
    docs = spark.createDataFrame([(1, "Ann met ann.", 7), (2, "nobody", 7), (None, "Ann", 7), (3, None, 7)], "doc_id long, text string, entity int")
    found = spark.createDataFrame([(1, "ann", "person_name", None), (3, "ann", None, 0.5), (9, "x", "y", 1.0)], FOUND)
    got = sorted(map(tuple, redaction.redacted(docs, found).collect()), key=str)
    assert got == sorted([(1, "[REDACTED_NAME] met [REDACTED_NAME].", 7, 2), (2, "nobody", 7, 0), (None, "Ann", 7, 0), (3, None, 7, 0)], key=str)


def test_scans_until_nothing_is_found(spark, tmp_path):
    """A text whose masking uncovers a second finding converges; one that uncovers one at every pass is reported."""

    def write(df, name):
        path = f"{tmp_path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    def find(docs):
        # What stands before a placeholder in parentheses is a secret as well.
        first = F.regexp_extract("text", r"(key\d+)", 1)
        next_ = F.regexp_extract("text", r"(\w{3,})\(\[REDACTED\]", 1)
        rows = docs.select("doc_id", F.explode(F.filter(F.array(first, next_), lambda x: x != "")).alias("entity"))
        return rows.select("doc_id", "entity", F.lit("custom_sensitive").alias("entity_type"), F.lit(1.0).alias("confidence"))

    docs = spark.createDataFrame([(1, "a (key1)"), (2, "abc(key2)"), (3, "e1x(d1x(c1x(b1x(key3)"), (4, "clean")], "doc_id long, text string")
    out, left = redaction.until_clean(docs, find, write)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "a ([REDACTED])", 2: "[REDACTED]([REDACTED])", 3: "e1x(d1x([REDACTED]([REDACTED]([REDACTED])", 4: "clean"}
    assert [(r["doc_id"], r["entity"]) for r in left.collect()] == [(3, "d1x")]


def test_fields_and_public_pages(spark):
    texts = ['{"username": "annlee", "id": "12345", "name":"Ann"}', 'say \\"sender\\": \\"Tom B\\" and \\"user_id\\":\\"u77\\"', "github.com/Python/cpython and github.com/annlee and https://raw.githubusercontent.com/google/x", "no-reply@x.org ann@x.org"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["rule"], r["entity"]) for r in scan.scan(df).collect()}
    assert {(0, "meta_username", "annlee"), (0, "meta_numeric_id", "12345"), (0, "meta_name", "Ann"), (1, "meta_sender", "Tom B"), (1, "meta_user_chat_id", "u77"), (2, "github_url_username", "annlee"), (3, "email", "ann@x.org")} <= got
    assert not any(e.lower() in ("python", "google") or "no-reply" in e for _, _, e in got)


@pytest.mark.parametrize("rule", [r[0] for r in scan.EVERY_RULE])
def test_hints_hold_wherever_rules_do(spark, rule):
    assert rule in scan.EVERY_HINT


def test_chain_over_documents(spark, small):
    """All documents of the small table: the chain's digests are those of replacing one entity after the other."""
    import hashlib

    from tracelake.plans.texts import redaction_chain, redaction_until_clean

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = {}
    df = redaction.without_allowed(scan.scan(spark.read.parquet(f"{small}/documents.parquet")), patterns=("example[.]",))
    for r in df.collect():
        found.setdefault(r["doc_id"], []).append((r["entity"], r["entity_type"], r["confidence"]))
    want = {}
    for i, text in docs.items():
        best, kept = {}, []
        for f in sorted(found.get(i, []), key=lambda f: (-f[2], f[1], f[0])):
            best.setdefault(f[0].lower(), f)
        for low, f in best.items():
            if not any(low != o and low in o for o in best):
                kept.append(f)
        masked, n = one_by_one(text or "", kept)
        want[i] = (n, hashlib.md5(masked.encode()).hexdigest())
    assert {r["doc_id"]: (r["n_redacted"], r["digest"]) for r in redaction_chain(spark, small).collect()} == want
    assert sum(n for n, _ in want.values()) > 10
    clean = redaction_until_clean(spark, small).collect()
    assert len(clean) == len(docs) and all(r["left"] == 0 for r in clean)
