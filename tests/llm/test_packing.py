import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import packing
from tracelake.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def best_fit_one_by_one(lengths, capacity):
    """Best fit in descending order, the plain way: number of sequences."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def filled(segments):
    """Places (offset, length) by sequence; every rank of a length is placed once."""
    used, seen = defaultdict(list), defaultdict(list)
    for length, low, high, first, per, base in segments:
        for r in range(low, high):
            seen[length].append(r)
            used[first + (r - low) // per].append((base + (r - low) % per * length, length))
    for ranks in seen.values():
        assert sorted(ranks) == list(range(len(ranks)))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
    return used, {length: len(ranks) for length, ranks in seen.items()}


@given(st.lists(st.integers(1, 40), max_size=80), st.integers(40, 60))
@settings(max_examples=60, deadline=None)
def test_a_sweep_is_best_fit(lengths, capacity):
    counts = Counter(lengths)
    segments, left, _, opened = packing.sweep([(n, 0, c) for n, c in counts.items()], [], capacity, 0)
    used, seen = filled(segments)
    assert not left and seen == counts and len(used) == opened == best_fit_one_by_one(lengths, capacity)
    assert all(sum(n for _, n in places) <= capacity for places in used.values())


@pytest.mark.parametrize("seed,capacity,kind", [(1, 50, "even"), (2, 64, "small"), (3, 4096, "mixed"), (4, 4096, "long"), (5, 7, "even"), (6, 4096, "one")])
def test_rounds_pack_all_as_well_as_one_by_one(spark, seed, capacity, kind):
    rng = np.random.default_rng(seed)
    draw = {"even": lambda: rng.integers(1, capacity + 1, 900), "small": lambda: rng.integers(1, capacity // 4, 900), "one": lambda: np.full(500, 1300),
            "mixed": lambda: np.minimum(capacity, rng.lognormal(6, 1.4, 1500).astype(int) + 1), "long": lambda: rng.integers(capacity // 3, capacity, 700)}
    lengths = draw[kind]().tolist()
    counts = Counter(lengths)
    table = spark.createDataFrame(list(counts.items()), "length long, n long")
    used, seen = filled([tuple(r) for r in packing.rounds(spark, table, capacity).collect()])
    assert seen == counts and all(sum(n for _, n in places) <= capacity for places in used.values())
    print(len(used), best_fit_one_by_one(lengths, capacity), -(-sum(lengths) // capacity))
    assert len(used) <= best_fit_one_by_one(lengths, capacity)


@pytest.mark.parametrize("text", ["", "Hello World", "a\x1cb c\x85d", "it's  12 <|endoftext|>x\n\n日本語 naïve", "\t x \r\n", "İ́ ́a"])
def test_encoder_equals_the_tokenizer(tokenizer, text):
    encode = packing.Encoder.of(tokenizer_path())
    assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


WORDS = st.text(st.sampled_from("abcXYZéÀßÿ×÷'’09.,!<|>-_ \n\t\r\x0b\x85日İ́µ"), max_size=40)


@given(st.lists(WORDS | st.text(max_size=12), max_size=6))
@settings(max_examples=150, deadline=None)
def test_batches_equal_the_tokenizer(texts):
    encode = packing.Encoder.of(tokenizer_path())
    for text, ids in zip(texts, encode.batches(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_are_forgotten_when_too_many(monkeypatch):
    monkeypatch.setattr(packing.Encoder, "WORDS", 50)
    monkeypatch.setattr(packing.Encoder, "BATCH", 200)
    encode = packing.Encoder(tokenizer_path())
    texts = [f"w{i}ord the{i % 7} Some-thing x{i * i}, {'long' * (i % 9)}" for i in range(300)]
    for text, ids in zip(texts, encode.batches(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encode.key) <= 150


def test_all_documents_are_packed_once(spark, docs, rows, tokenizer):
    got = packing.packed_documents(spark, docs, tokenizer_path(), keep_ids=True).toPandas()
    want = []
    for key, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], "<u4")
            want.append((-1 if key is None else key, piece, start, len(part), zlib.crc32(part.tobytes())))
    found = got[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype(int)
    assert sorted(map(tuple, found.to_numpy().tolist())) == sorted(want)
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]]
        assert part["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= best_fit_one_by_one(got["length"].tolist(), 4096)


def test_sequences_hold_the_ids(spark, docs):
    packed = packing.packed_documents(spark, docs, tokenizer_path(), keep_ids=True)
    whole = packing.sequences(packed).toPandas().set_index("sequence_id")
    for r in packed.toPandas().itertuples():
        ids = bytes(whole.loc[r.sequence_id, "ids"])
        assert zlib.crc32(ids[4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32
        assert len(ids) == 4 * whole.loc[r.sequence_id, "n_tokens"]


def test_empty_table(spark, empty):
    assert packing.packed_documents(spark, empty, tokenizer_path()).count() == 0
