"""Runs of repeated words in texts, by recompression.

The texts of a batch are one sequence of word numbers with a separator of its own around each text. Recompression shortens it in rounds: equal neighbours become
blocks with a length, then symbols are divided into left and right ones and each left one joins the right one that follows. Each round is a level of a run-length
grammar; equal stretches are cut alike inside, so two places are compared symbol by symbol while climbing to levels where one symbol stands for many words,
and on the way down again, a few steps a level. That answers how far two places agree, forward and, as the cuts are symmetric, backward.

A run of period q and four periods holds two neighbours q apart at some multiple of 3q: for all q these places form a harmonic grid, about n/3 ln n of them. Where
the two words agree, the exact extension in both directions gives the run.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nosoflow.llm.common import byte_words, mixed, texts

#: A run has at least so many words, and at least so many periods.
LEAST, PERIODS = 6, 4
#: Words of the texts that are compressed together, a longer text being alone, and grid places looked at together.
BATCH, PLACES = 1 << 18, 1 << 20


@dataclass
class Level:
    """Symbols of a level, their lengths in words, the symbol of the next level that each belongs to, and each one's first symbol on the level below."""

    symbols: np.ndarray
    lengths: np.ndarray
    parents: np.ndarray | None = None
    firsts: np.ndarray | None = None

    def mirrored(self, above: "Level | None", below: "Level | None") -> "Level":
        parents = None if self.parents is None else len(above.symbols) - 1 - self.parents[::-1]
        firsts = None if self.firsts is None else len(below.symbols) - self.firsts[::-1]
        return Level(self.symbols[::-1], self.lengths[::-1], parents, firsts)


def _raised(levels: list[Level], starts: np.ndarray, symbols: np.ndarray) -> None:
    """Adds a level whose symbols begin at ``starts`` of the last one."""
    last = levels[-1]
    firsts = np.append(starts, len(last.symbols))
    last.parents = np.repeat(np.arange(len(starts)), np.diff(firsts))
    levels.append(Level(symbols, np.add.reduceat(last.lengths, starts), firsts=firsts))


def _blocks(levels: list[Level], free: int) -> int:
    """Block compression: equal neighbours become one symbol for (symbol, count). Returns the next free symbol."""
    symbols = levels[-1].symbols
    starts = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
    if len(starts) == len(symbols):
        return free
    counts = np.diff(np.append(starts, len(symbols)))
    named, several = symbols[starts], counts > 1
    rules, names = np.unique(named[several] * (int(counts.max()) + 1) + counts[several], return_inverse=True)
    named[several] = free + names
    _raised(levels, starts, named)
    return free + len(rules)


def _pairs(levels: list[Level], free: int, separators: int, salt: int) -> int:
    """Pair compression: symbols are dealt to two sides by a hash; a left one and the right one after it become one symbol."""
    symbols = levels[-1].symbols
    right = (mixed(symbols.astype(np.uint64) + np.uint64(salt << 40)) & np.uint64(1)).astype(bool)
    inner = symbols >= separators
    joined = (inner & ~right)[:-1] & (inner & right)[1:]
    if not joined.any():
        return free
    starts = np.flatnonzero(np.concatenate(([True], ~joined)))
    named, pair = symbols[starts], np.append(joined, False)[starts]
    rules, names = np.unique(named[pair] * free + symbols[starts[pair] + 1], return_inverse=True)
    named[pair] = free + names
    _raised(levels, starts, named)
    return free + len(rules)


def grammar(numbers: np.ndarray, separators: int) -> list[Level]:
    """Levels over a sequence whose first ``separators`` numbers occur once each, one at either end, and are never joined.

    The last level has one symbol between neighbouring separators at most.
    """
    levels, free, salt = [Level(numbers.astype(np.int64), np.ones(len(numbers), np.int64))], int(numbers.max()) + 1, 0
    while True:
        inner = levels[-1].symbols >= separators
        if not (inner[1:] & inner[:-1]).any():
            return levels
        free = _blocks(levels, free)
        salt += 1
        free = _pairs(levels, free, separators, salt)


def agreement(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal words from the places ``a`` and ``b`` on, which differ.

    A query climbs while both places begin equal symbols of the next level, else it passes the symbol, or the shared part of a block. Where symbols differ it
    goes down again, to the first words that do.
    """
    out = np.zeros(len(a), np.int64)
    query, a, b = np.arange(len(a)), a.copy(), b.copy()
    parted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    for number, level in enumerate(levels):
        risen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        split: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        above = levels[number + 1] if number + 1 < len(levels) else None
        while len(query):
            equal = level.symbols[a] == level.symbols[b]
            split.append((query[~equal], a[~equal], b[~equal]))
            query, a, b = query[equal], a[equal], b[equal]
            if above is not None:
                over_a, over_b = level.parents[a], level.parents[b]
                up = (above.firsts[over_a] == a) & (above.firsts[over_b] == b) & (above.symbols[over_a] == above.symbols[over_b])
                risen.append((query[up], over_a[up], over_b[up]))
                query, a, b = query[~up], a[~up], b[~up]
                left = np.minimum(_left(level, above, a), _left(level, above, b))
                out[query] += left * level.lengths[a]
                a, b = a + left, b + left
            else:
                out[query] += level.lengths[a]
                a, b = a + 1, b + 1
        parted.append(tuple(np.concatenate(x) for x in zip(*split)) if split else (query, a, b))
        if not risen:
            break
        query, a, b = (np.concatenate(x) for x in zip(*risen))
    query, a, b = (np.zeros(0, np.int64),) * 3
    for number in range(len(parted) - 1, 0, -1):
        level, above, below = levels[number], levels[number + 1] if number + 1 < len(levels) else None, levels[number - 1]
        query, a, b = (np.concatenate(x) for x in zip((query, a, b), parted[number]))
        a, b = level.firsts[a], level.firsts[b]
        # Now on the level below: past what is still equal there.
        going = np.arange(len(query))
        while len(going):
            going = going[below.symbols[a[going]] == below.symbols[b[going]]]
            left = np.minimum(_left(below, level, a[going]), _left(below, level, b[going]))
            out[query[going]] += left * below.lengths[a[going]]
            a[going] += left
            b[going] += left
    return out


def _left(level: Level, above: Level, at: np.ndarray) -> np.ndarray:
    """1, or inside a block the copies from ``at`` to its end."""
    end = above.firsts[level.parents[at] + 1]
    block = level.symbols[end - 1] == level.symbols[at]
    return np.where(block, end - at, 1)


def _grid(starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and periods q of the harmonic grid of texts that begin at ``starts`` with ``counts`` words, in portions."""
    text = np.flatnonzero(counts >= LEAST)
    periods = counts[text] // PERIODS
    owner = np.repeat(text, periods)
    q = np.arange(len(owner)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = (PERIODS - 1) * q
    places = -(-(counts[owner] - q) // step)
    ends = np.cumsum(places)
    at = 0
    while at < len(owner):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, side="right")))
        n = places[at:to]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(starts[owner[at:to]], n) + nth * np.repeat(step[at:to], n), np.repeat(q[at:to], n)
        at = to


def runs_of(numbers: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, length, period of all runs, by place, of texts within a sequence that ``grammar`` takes. Starts are places of the sequence."""
    found = []
    levels: list[Level] | None = None
    mirror: list[Level] = []
    for place, q in _grid(starts, counts):
        same = numbers[place] == numbers[place + q]
        place, q = place[same], q[same]
        if not len(place):
            continue
        if levels is None:
            levels = grammar(numbers, len(starts) + 1)
            below, above = [None, *levels[:-1]], [*levels[1:], None]
            mirror = [level.mirrored(u, d) for level, u, d in zip(levels, above, below)]
        ahead = agreement(levels, place, place + q)
        enough = np.maximum(LEAST, PERIODS * q) - q
        last = len(numbers) - 1
        behind = agreement(mirror, last - (place - 1), last - (place + q - 1))
        long = ahead + behind >= enough
        found.append(np.stack([place - behind, ahead + behind + q, q], 1)[long])
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]  # of equal stretches the least period comes first; the others are its multiples
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


class _Numbers(dict):
    def __init__(self, free: int):
        super().__init__()
        self.free = free

    def __missing__(self, word: bytes) -> int:
        value = self[word] = self.free + len(self)
        return value


def _described(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
    counts = np.array([len(words) for _, words in held], np.int64)
    starts = np.cumsum(counts + 1) - counts  # a separator before each text, and one at the end
    numbers = np.empty(int(counts.sum()) + len(held) + 1, np.int64)
    numbers[starts - 1] = np.arange(len(held))
    numbers[-1] = len(held)
    known = _Numbers(len(held) + 1)
    for (_, words), start in zip(held, starts.tolist()):
        numbers[start:start + len(words)] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    runs = runs_of(numbers, starts, counts)
    gone = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(gone) > 0
    edges = np.searchsorted(runs[:, 0], np.append(starts, len(numbers)))
    listed, collapsed = [], []
    for (_, words), start, low, high in zip(held, starts.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
        listed.append([{"start": s - start, "length": n, "period": q} for s, n, q in runs[low:high].tolist()])
        if low < high:
            words = [w for w, drop in zip(words, gone[start:start + len(words)].tolist()) if not drop]
        collapsed.append(b" ".join(words))
    run = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
    columns = [pa.array([i for i, _ in held], pa.int64()), pa.array(listed, pa.list_(run)), pa.array(collapsed, pa.binary()).cast(pa.string())]
    return pa.record_batch(columns, names=["doc_id", "runs", "collapsed"])


_RUNS = "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def find_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, runs (start, length, period by start, then period), collapsed.

    Words are what stands between ASCII blanks (``common.byte_words``), numbered from 0; ``change`` may alter them, given the id. A run is a stretch with a smallest
    period q and max(6, 4 q) words or more that no neighbouring word continues. ``collapsed`` joins by one space the words that no run holds after
    its first period. A null text and one without words have no runs and collapse to the empty text. Rows, repeated or without an id, are
    treated each on its own; no other column is read. No shuffle: a task holds the texts of about ``BATCH`` words, or one longer text.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = byte_words(text.as_py())
                if change:
                    words = change(doc_id, words)
                if held and size + len(words) > BATCH:
                    yield _described(held)
                    held, size = [], 0
                held.append((doc_id, words))
                size += len(words) + 1
        if held:
            yield _described(held)

    return texts(docs).mapInArrow(find, _RUNS)


def with_repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """For a tenth of the ids, by crc32 of the id as text, the words from some place on become repetitions of the first of them. A null id changes nothing."""
    if doc_id is None or not words:
        return words
    code = zlib.crc32(str(doc_id).encode())
    if code % 10:
        return words
    group, n = code // 10, len(words)
    at = group % n
    period = 1 + (n - at) // (3 + group % 8)
    return words[:at] + (words[at:at + period] * (-(-(n - at) // period)))[:n - at]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, the longest run, digests of all runs and of the collapsed text, as ``find_runs`` gives them.

    The longest run is that of the greatest length, then smallest start, then period; without runs its four columns are null. A tenth of the texts
    get a repeated tail before (``with_repeated_tail``).
    """
    found = find_runs(docs, with_repeated_tail)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
