import re
from collections import Counter, defaultdict

import pytest

from tracelake.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    found = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {j for i in range(len(words) - 7) if found[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def kept(rows, line_docs, line_share, keep_share):
    """The verdict of every row, the plain way."""
    norm = lambda x: " ".join(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x)))
    texts = defaultdict(list)
    for r in rows:
        texts[r[3]].append(r[1] or "")
    common = {}
    for host, own in texts.items():
        n = Counter(x for t in own for x in {norm(x) for x in t.split("\n") if norm(x)})
        common[host] = {x for x, c in n.items() if c > line_docs and c > line_share * len(own)}
    out = []
    for r in rows:
        n, _, _, _, repeat = base(r[1])
        left = sum(len(WORD.findall(x)) for x in (r[1] or "").split("\n") if norm(x) not in common[r[3]])
        out.append(n >= 20 and 100 * repeat <= 30 * n and left >= keep_share * n)
    return out


def test_equals_brute_force(spark, docs, rows):
    got = sorted(tuple(-1 if x is None else x for x in r) for r in quality_rules.judged(spark, docs).drop("n_removed_words").collect())
    want = sorted((-1 if r[0] is None else r[0], *base(r[1]), base(r[1])[0] < 20 or 100 * base(r[1])[4] > 30 * base(r[1])[0], k) for r, k in zip(rows, kept(rows, 10, 0.05, 0.2), strict=True))
    assert got == want


def test_boilerplate_goes_and_depleted_documents_are_rejected(spark):
    menu = "Home About   Contact Us\nall rights reserved by the owners of this site and its very many friends"
    rows = [(i, f"{menu}\nown words {i} " + " ".join(f"u{i}x{j}" for j in range(30 if i % 2 else 3)), "en", "h", 0) for i in range(30)]
    rows += [(100 + i, rows[0][1] if i < 10 else " ".join(f"v{i}x{j}" for j in range(30)), "en", "other", 0) for i in range(30)]  # ten documents are not above the limit
    df = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judged(spark, df, keep_share=0.5).collect()}
    assert got == dict(zip((r[0] for r in rows), kept(rows, 10, 0.05, 0.5), strict=True))
    assert got[1] and not got[0] and got[100]
    clean = {r["doc_id"]: r["text"] for r in quality_rules.cleaned(spark, df).collect()}
    assert clean[0] == rows[0][1].split("\n")[2] and clean[100] == rows[0][1]


@pytest.mark.parametrize("text", ["a b c d e f g h a b c d e f g h", "a " * 40, "x " * 7, "a b " * 8, "a b c d e f g h i a b c d e f g h"])
def test_repeated_words(text):
    from tracelake.llm.common import WordHashes

    words = text.encode().split()
    assert quality_rules.repeated_words(WordHashes().of(words), words) == base(text)[4]


def test_empty_table_and_other_columns(spark, empty, docs):
    assert quality_rules.judged(spark, empty).count() == 0
    assert quality_rules.cleaned(spark, docs).columns == docs.columns
