"""Conversations as training text with a loss mask, held by a grammar round trip.

The grammar, without white space that isn't written here::

    conversation = turn*
    turn         = "### " name ": " content "\\n</turn>\\n"
    control      = "### " name ": " | "</turn>"
    content      = any text in which each control has a backslash before it

``name`` is the role in percent-encoding; a first letter a-z becomes upper
case, and a role's own first letter A-Z is percent-encoded. In contents the
parser takes one backslash off every control that has backslashes before it.

Turns are first rendered as they are. The deterministic parser reads the text
back turn by turn; where what it recovers differs from the source, that turn's
content is escaped (one more backslash before each control) and parsed again,
until all turns are identical. So only turns in conflict are changed. The
mask has the places of assistant contents.

Turns are sorted into ranges by conversation and turn, so that a conversation
of any length is in many ranges. A range's turns are rendered in pieces of a
bounded size, each of whole turns; a conversation's pieces, ordered by (part,
piece), are its text. Reading back parses every piece; digests of
conversations in one piece are made where it is read, only the others meet by
conversation, where a task streams their pieces in order (a digest is
sequential by its definition) and holds one piece at a time.

Defined results: null role or text is empty; a null turn comes first; turns of
one number go by the SHA-256 of length of role in bytes, ":", role and text;
repeated rows are turns of their own; rows with a null conv_id are one
conversation; a text longer than PIECE has a piece of its own and is never
cut; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import written
from tracelake.llm.turns import in_order, keyed

#: Characters after which a piece ends.
PIECE = 1 << 20
END = "\n</turn>\n"
HEADER = re.compile(r"### ([A-Za-z0-9%._~-]*): ")
CONTROL = re.compile(r"(\\*)(?:</turn>|### [A-Za-z0-9%._~-]*: )")
FORMATTED = "conv_id long, part int, piece long, whole boolean, formatted string, mask array<struct<start: int, stop: int>>, n_escaped long"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Conflict(ValueError):
    """A text that the grammar doesn't derive."""


def name_of(role: str) -> str:
    name = quote(role, safe="")
    if "a" <= name[:1] <= "z":
        return name[0].upper() + name[1:]
    return f"%{ord(name[0]):02X}{name[1:]}" if "A" <= name[:1] <= "Z" else name


def role_of(name: str) -> str:
    return unquote(name[0].lower() + name[1:] if "A" <= name[:1] <= "Z" else name)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text) if "</turn>" in text or "### " in text else text


def unescape(content: str) -> str:
    return CONTROL.sub(lambda m: m[0][1:] if m[1] else m[0], content) if "\\" in content else content


def parse_turn(text: str, at: int) -> tuple[str, int, int, int]:
    """(role, start and stop of the content, where the next turn starts) of the turn at a place."""
    header = HEADER.match(text, at)
    if not header:
        raise Conflict(f"no header at {at}")
    for m in CONTROL.finditer(text, header.end()):
        if m[1]:
            continue
        if m[0] != "</turn>" or m.start() == header.end() or not text.startswith(END, m.start() - 1):
            raise Conflict(f"a control at {m.start()}")
        return role_of(header[1]), header.end(), m.start() - 1, m.end() + 1
    raise Conflict(f"a turn at {at} has no end")


def parse(text: str) -> Iterator[tuple[str, int, int]]:
    """(role, start, stop) of each turn's content."""
    at = 0
    while at < len(text):
        role, start, stop, at = parse_turn(text, at)
        yield role, start, stop


def render_turn(role: str, text: str) -> tuple[str, int, int, bool]:
    """(rendered, start and stop of the content, whether it was escaped): as it is if the parser gives the turn back."""
    head = f"### {name_of(role)}: "
    for content in (text, escape(text)):
        rendered = head + content + END
        try:
            got, start, stop, after = parse_turn(rendered, 0)
        except Conflict:
            continue
        if after == len(rendered) and got == role and unescape(rendered[start:stop]) == text:
            return rendered, start, stop, content != text
    raise AssertionError("an escaped turn is always recovered")


def _render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of the conversations of one range, which come in order."""
    part, piece = TaskContext.get().partitionId(), 0
    none = object()
    now, first_conv, begun, pieces, size, escaped, mask, texts = none, none, 0, [], 0, 0, [], []

    def close(more: bool) -> None:
        nonlocal piece, size, escaped, mask, texts
        # A conversation at an end of the range, or in several pieces, may have others elsewhere.
        whole = not more and now is not first_conv and begun == piece
        pieces.append((None if now is None else int(now), part, piece, whole, "".join(texts), mask, escaped))
        piece, size, escaped, mask, texts = piece + 1, 0, 0, [], []

    for pdf in frames:
        for conv, role, text in zip(pdf["conv_id"].array, pdf["role"], pdf["text"], strict=True):
            conv = None if pd.isna(conv) else conv
            if now is none or conv != now:
                if now is not none:
                    close(False)
                now = conv
                begun = piece
                if first_conv is none:
                    first_conv = now
            elif size >= PIECE:
                close(True)
            rendered, start, stop, changed = render_turn(role, text)
            texts.append(rendered)
            escaped += changed
            if role == "assistant":
                mask.append({"start": size + start, "stop": size + stop})
            size += len(rendered)
        columns = [c.split()[0] for c in FORMATTED.split(", ")[:5]] + ["mask", "n_escaped"]
        yield pd.DataFrame(pieces, columns=columns).astype({"conv_id": "Int64"})
        pieces.clear()
    if now is not none:
        close(True)
        yield pd.DataFrame(pieces, columns=columns).astype({"conv_id": "Int64"})


def formatted(spark: SparkSession, conversations: DataFrame, **names: str) -> DataFrame:
    """conv_id, part, piece, whole, formatted, mask, n_escaped: the conversations' text in pieces, as a written table.

    ``whole``: the piece is known to be its conversation's only one. The mask
    counts characters (code points) of the piece.
    """
    rows = in_order(spark, keyed(conversations, **names)).select("conv_id", "role", "text")
    return written(spark, rows.mapInPandas(_render, FORMATTED), "formatted")


class Reader:
    """What is read back from a conversation's pieces, one after the other."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def read(self, text: str, mask: list[tuple[int, int]]) -> None:
        for role, start, stop in parse(text):
            self.turns.update(f"{role}\n{unescape(text[start:stop])}\n".encode())
            self.n_turns += 1
        for start, stop in mask:
            content = unescape(text[start:stop])
            self.loss.update(content.encode())
            self.loss_chars += len(content)
        self.chars += len(text)

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of conversations whose pieces come one after the other, in order."""
    none = object()
    now, reader = none, None
    columns = [c.split()[0] for c in READ.split(", ")]
    for pdf in frames:
        done = []
        for conv, whole, text, mask in zip(pdf["conv_id"].array, pdf["whole"], pdf["formatted"], pdf["mask"], strict=True):
            conv = None if pd.isna(conv) else int(conv)
            if now is none or conv != now or whole:
                if now is not none:
                    done.append(reader.row(now))
                now, reader = conv, Reader()
            reader.read(text, [(m["start"], m["stop"]) for m in mask])
        yield pd.DataFrame(done, columns=columns).astype({"conv_id": "Int64"})
    if now is not none:
        yield pd.DataFrame([reader.row(now)], columns=columns).astype({"conv_id": "Int64"})


def read_back(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, parsed from its pieces."""
    columns = ["conv_id", "whole", "formatted", "mask"]
    one = pieces.where("whole").select(*columns).mapInPandas(_read, READ)
    rest = pieces.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return one.unionByName(rest.select(*columns).mapInPandas(_read, READ))
