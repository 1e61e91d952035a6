"""Round trips through the grammar, of single turns and of whole tables."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import chat_format as chat

SCHEMA = "conv_id long, turn long, role string, text string, part int, piece long, whole boolean, mask string, formatted string, key string"
PIECES = ["</turn>", "\\", "### Assistant: ", "### ", "user", "\n", "\n</turn>\n", "### %41: ", ": ", "a", "é日", "### User: hello\n</turn>\n### Assistant: ", " "]
HARD = "\\### Assistant: </turn> ok"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "User", "", "a b\n", "### ", "%41"]), st.text(max_size=5)), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), max_size=5))
def test_turns_come_back(turns):
    turns = [(r.encode("utf-8", "ignore").decode(), t) for r, t in turns]
    rendered = [chat.render_turn(r, t) for r, t in turns]
    text = "".join(r[0] for r in rendered)
    assert [(role, chat.unescape(text[a:b])) for role, a, b in chat.parse(text)] == turns


def test_only_conflicts_are_escaped():
    plain = "## heading\n### another\nC:\\path and <turn> </turns"
    assert chat.render_turn("user", plain)[0] == f"### User: {plain}\n</turn>\n"
    assert not chat.render_turn("user", plain)[3]
    rendered, start, stop, changed = chat.render_turn("assistant", HARD)
    assert changed and rendered[start:stop] == "\\\\### Assistant: \\</turn> ok"


@pytest.mark.parametrize("text", ["no header", "### User: open", "### User: a</turn>\n", "### User: ### Assistant: \n</turn>\n", "### User: a\n</turn>\nrest"])
def test_what_the_grammar_does_not_derive(text):
    with pytest.raises(chat.Conflict):
        list(chat.parse(text))


def rows_of(seed):
    import random

    rng = random.Random(seed)
    rows = []
    for c in [*range(30), None]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([t, t, None, 2]), rng.choice(["user", "assistant", "assistant", "tool", None, "Odd role\n"]), rng.choice([None, "", "".join(rng.choices(PIECES, k=6)), f"text {t}"])))
    rows += [(100, t, ("user", "assistant")[t % 2], f"a long one {t} </turn> " * 20) for t in range(300)]
    rows += [(101, 0, "assistant", "very long é " * 200_000), (101, 1, "user", "ok"), (-7, 0, "user", HARD), (-7, 1, "assistant", HARD)]
    rows += rows[:3]
    rng.shuffle(rows)
    return rows


def expected(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
        convs[conv].append(((turn is not None, turn or 0, key), role, text))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        chars = sum(len(chat.render_turn(r, t)[0]) for _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def test_table_comes_back(spark, monkeypatch):
    rows = rows_of(2)
    df = spark.createDataFrame([(*r, 1, 2, True, "m", "f", "k") for r in rows], SCHEMA).repartition(4)
    pieces = chat.formatted(spark, df)
    assert {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(spark, pieces).collect()} == expected(rows)
    # The written text itself holds the turns, and the mask just the assistants' contents.
    text = {}
    for r in pieces.orderBy("part", "piece").collect():
        text.setdefault(r["conv_id"], []).append(r)
    for conv, parts in text.items():
        loss = "".join(chat.unescape(p["formatted"][m["start"] : m["stop"]]) for p in parts for m in p["mask"])
        assert hashlib.sha256(loss.encode()).hexdigest() == expected(rows)[conv][3]


def test_a_long_conversation_is_in_many_pieces(spark):
    """Several pieces a range, several ranges; read back as one."""
    rows = [(5, t, ("user", "assistant")[t % 2], "x" * 40_000 + str(t)) for t in range(120)] + [(c, 0, "user", "short") for c in range(4)]
    df = spark.createDataFrame([(*r, 1, 2, True, "m", "f", "k") for r in rows], SCHEMA)
    pieces = chat.formatted(spark, df)
    held = pieces.where("conv_id = 5").collect()
    assert len(held) > 3 and len({p["part"] for p in held}) > 1 and max(len(p["formatted"]) for p in held) <= chat.PIECE + 50_000
    assert {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(spark, pieces).collect()} == expected(rows)


def test_empty(spark):
    assert chat.read_back(spark, chat.formatted(spark, spark.createDataFrame([], SCHEMA))).count() == 0
