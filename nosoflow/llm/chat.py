"""Conversations as one text with turn marks and a loss mask, checked by a grammar round trip.

A turn is ``<|im_start|>role``, a line break, its text, ``<|im_end|>`` and a line break. The parser takes every ``<|name|>`` for a mark. Each rendered
turn is parsed again and compared with its source; where they differ, the conflicting content is escaped by one more backslash
inside every ``<|`` and checked again, so that any text can be read back unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nosoflow.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
#: A formatted row is closed at so many turns or characters; a longer conversation takes several rows.
SEGMENT_TURNS, SEGMENT_CHARS = 256, 1 << 20
_MARK = re.compile(r"<\|\w+\|>")
_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE_OPEN, _ROLE_SHUT = re.compile(r"<(\\*n?)\|"), re.compile(r"<\\(\\*n?)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return _ROLE_OPEN.sub(r"<\\\1|", role).replace("\n", "<n|")


def unescape_role(role: str) -> str:
    return _ROLE_SHUT.sub(r"<\1|", role.replace("<n|", "\n"))


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """Turns as (role, text, start and end of the text as it stands), or None if the text doesn't follow the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            return None
        line = formatted.find("\n", at)
        if line < 0 or _MARK.search(formatted, at + len(START), line):
            return None
        mark = _MARK.search(formatted, line + 1)
        if not mark or mark[0] != END or not formatted.startswith("\n", mark.end()):
            return None
        turns.append((unescape_role(formatted[at + len(START):line]), unescape(formatted[line + 1:mark.start()]), line + 1, mark.start()))
        at = mark.end() + 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn that parses back to exactly this role and text; start and end of the text within it."""
    shown_role, shown = role, text
    while True:
        turn = f"{START}{shown_role}\n{shown}{END}\n"
        found = parse(turn)
        if found and len(found) == 1 and found[0][:2] == (role, text):
            return turn, found[0][2], found[0][3]
        if shown != escape(text) and (not found or len(found) != 1 or found[0][1] != text):
            shown = escape(text)
        elif shown_role != escape_role(role):
            shown_role = escape_role(role)
        else:
            raise AssertionError("a turn that can't be escaped")


def _conversations(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


_FORMATTED = "conv_id bigint, segment int, formatted string, loss_start array<int>, loss_end array<int>"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _FORMATTED.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    rows: list[tuple] = []
    held, size = 0, 0  # characters in rows, and in the open segment
    owner, segment, parts, starts, ends = None, 0, [], [], []

    def close() -> None:
        if parts:
            rows.append((owner, segment, "".join(parts), starts, ends))

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for conv_id, role, text in _conversations(batches, ["conv_id", "role", "text"]):
        if parts and (conv_id != owner or len(parts) >= SEGMENT_TURNS or size >= SEGMENT_CHARS):
            close()
            held, segment = held + size, segment + 1 if conv_id == owner else 0
            parts, starts, ends, size = [], [], [], 0
            if held >= SEGMENT_CHARS:
                yield batch()
                rows, held = [], 0
        owner = conv_id
        turn, start, end = render(role, text)
        if role == LEARNED_ROLE:
            starts.append(size + start)
            ends.append(size + end)
        parts.append(turn)
        size += len(turn)
    close()
    if rows:
        yield batch()


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, segment, formatted, loss_start, loss_end: the mask's spans in code points of ``formatted``.

    Turns are ordered by number (null first), those of equal numbers by role and text; all rows are kept, repeated ones too. Null texts
    and roles are empty; rows without conv_id form a conversation of their own. A conversation is streamed through one task
    and cut into rows of bounded size, so even a very long one needs little memory. Further columns are ignored.
    """
    c = conversations
    rows = c.select(c["conv_id"].cast("bigint").alias("conv_id"), c["turn"].cast("bigint").alias("turn"), *(F.coalesce(c[x], F.lit("")).alias(x) for x in ("role", "text")))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format, _FORMATTED)


def digests(output: DataFrame) -> DataFrame:
    """What ``formatted`` holds, read back with the parser: one row per conversation, as the query returns it."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, state, rows = None, None, []
        for conv_id, text, starts, ends in _conversations(batches, ["conv_id", "formatted", "loss_start", "loss_end"]):
            if state is None or conv_id != owner:
                if state:
                    rows.append((owner, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    if len(rows) >= 10_000:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                owner, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            turns = parse(text)
            if turns is None:
                raise ValueError(f"conversation {conv_id} doesn't follow the grammar")
            state[0] += len(turns)
            state[4] += len(text)
            for role, said, _, _ in turns:
                state[1].update(f"{role}\n{said}\n".encode())
            for a, b in zip(starts, ends):
                said = unescape(text[a:b])
                state[2] += len(said)
                state[3].update(said.encode())
        if state:
            rows.append((owner, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = ", ".join(f"{n} {'string' if k == pa.string() else 'bigint'}" for n, k in zip(names, kinds))
    return output.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(read, schema)


def with_probe(conversations: DataFrame, text: str = f"{END}{START}assistant ok") -> DataFrame:
    """The conversations plus number -1, whose user and assistant both say ``text``."""
    c = conversations
    own = c.select(c["conv_id"].cast("bigint").alias("conv_id"), c["turn"].cast("bigint").alias("turn"), c["role"].alias("role"), c["text"].alias("text"))
    probe = c.sparkSession.createDataFrame([(-1, i, role, text) for i, role in enumerate(("user", LEARNED_ROLE))], "conv_id bigint, turn bigint, role string, text string")
    return own.unionByName(probe)


def round_trip(conversations: DataFrame) -> DataFrame:
    """Format, write, read back and return the digests."""
    return digests(stored(formatted(with_probe(conversations)), "formatted"))
