import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, `row` string, cls string, `key` string, host string, copies long, length int, slot int, label string"


def random_text(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" + rng.choice(["", "", ".", ",\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and very long texts, copies, near copies, repeated rows, null ids and sources."""
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "one two three four", "One two three FOUR", random_text(rng, 30_000, 5000)]
    base = [random_text(rng, rng.randrange(20, 300), 3000) for _ in range(40)]
    texts += base + base[:10] + base[:3] * 4
    for t in base[:20]:
        words = t.split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += ["to " * 30 + "of " * 30 + "x y z", "token = 'abcdef123456'", "é è 日本 " * 12]
    out = [(i, t, "en", f"src{i % 5}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    out += [out[9], out[9], (None, base[0], "en", "src1", 1), (None, None, None, None, None), (9, base[30], "en", "src2", 2)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with further columns whose names clash with those that operators use."""
    return spark.createDataFrame([(*r, 7, 1, "r", "c", "k", "h", 3, 4, 5, "l") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
