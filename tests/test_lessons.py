"""Similarity of lessons and their ranked selection against a plain walk."""

import random
import re
import uuid
from difflib import SequenceMatcher

import pytest

from tracelake.operators import lessons

SCHEMA = "place long, kind string, taxonomy string, origin string, title string, guidance string, trigger string, fresh boolean, support double"
VOCABULARY = "flagging flags fixed fixes waited wait running tests testing string timing database api responses validate check stopped stops the never review".split()


def stem(w):
    w = w[:-1] if w.endswith("s") and len(w) > 3 else w
    w = w[:-3] if w.endswith("ing") and len(w) > 6 else w[:-2] if w.endswith("ed") and len(w) > 4 else w
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "aeiou" else w


def stems(text, least):
    return [stem(w) for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) >= least and w not in lessons.STOP]


def alike(a, b):
    _, kind_a, mode_a, origin_a, title_a, guide_a, trigger_a = a[:7]
    _, kind_b, mode_b, origin_b, title_b, guide_b, trigger_b = b[:7]
    if origin_a == origin_b == "objective":
        return kind_a == kind_b and (guide_a or "").strip() == (guide_b or "").strip()
    if title_a and title_a.strip().lower() == (title_b or "").strip().lower():
        return True
    x, y = stems(title_a, 1), stems(title_b, 1)
    ga, gb, ta, tb = set(stems(guide_a, 3)), set(stems(guide_b, 3)), set(stems(trigger_a, 3)), set(stems(trigger_b, 3))
    mode = bool(mode_a) and mode_a == mode_b
    backs = lambda p, q: len(p & q) >= 2 and len(p & q) / min(len(p), len(q)) >= 0.15
    common = set(x) & set(y)
    if len(common) >= 2 and (mode or backs(ga, gb) or backs(ta, tb)):
        swap = x[0] == y[0] and any(t == "replace" and i > 0 and j > 0 for t, i, _, j, _ in SequenceMatcher(None, x, y, autojunk=False).get_opcodes())
        if not swap and (common in (set(x), set(y)) or len(common) / len(set(x) | set(y)) >= 0.5):
            return True
    words = len(ga & gb) / len(ga | gb) if ga and gb else 0.0
    return mode or words >= 0.3 if kind_a == kind_b else words >= 0.4


def walk(rows):
    kept = []
    for r in sorted(rows):
        r = list(r)
        at = next((i for i, (_, k) in enumerate(kept) if alike(r, k)), None)
        if at is None:
            kept.append((r[0], r))
        elif kept[at][1][7] and not r[7]:
            r[8] = max(r[8], kept[at][1][8])
            kept[at] = (kept[at][0], r)
        elif not kept[at][1][7] and r[7]:
            kept[at][1][8] = max(kept[at][1][8], r[8])
    return sorted((r[0], slot, r[8]) for slot, r in kept)


def made(seed, n):
    rng = random.Random(seed)
    text = lambda a, b: " ".join(rng.choices(VOCABULARY, k=rng.randrange(a, b)))
    rows = []
    for i in range(n):
        rows.append((i, rng.choice(["do", "avoid"]), rng.choice([None, "", None, "m1", "m2"]) if rng.random() < 0.2 else None, rng.choice(["model", "model", "objective", None]), rng.choice([None, text(1, 5).title(), text(2, 4)]), rng.choice([text(4, 12), text(1, 4), None]), rng.choice([None, text(3, 8)]), rng.random() < 0.5, float(rng.randrange(9))))
    return rows


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in ["flagging", "flag", "waited", "string", "timing", "passes", "need", "boss", "stopped", "free", "agreed"]], "w string")
    got = {r["w"]: r["s"] for r in df.select("w", lessons.stem(df["w"]).alias("s")).collect()}
    assert got == {w: stem(w) for w in got}


@pytest.mark.parametrize("seed, n", [(1, 50), (2, 90)])
def test_equals_a_plain_walk(spark, tmp_path, seed, n):
    rows = made(seed, n)

    def write(df, name):
        path = f"{tmp_path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    pairs = lessons.alike(df)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and alike(a, b)}
    assert {tuple(r) for r in pairs.collect()} == want and want
    got = sorted((r["place"], r["slot"], r["support"]) for r in lessons.selected(df, pairs, write).collect())
    assert got == walk(rows)
    assert any(p != s for p, s, _ in got)


def test_query_equals_a_plain_walk(spark, small):
    from tracelake.plans.texts import benchmark_lessons, lesson_pairs, near_duplicate_collapse

    rows = sorted(map(tuple, benchmark_lessons(spark, small).collect()))
    assert {tuple(r) for r in lesson_pairs(spark, small).collect()} == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and alike(a, b)}
    assert sorted((r["place"], r["slot"], r["support"]) for r in near_duplicate_collapse(spark, small).collect()) == walk(rows)
