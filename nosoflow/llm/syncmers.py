"""Document fingerprints of closed syncmers.

A k-mer of a text's code points is chosen if the smallest of its inner s-mers, by hash, is its first or its last. Whether it is chosen depends on the k-mer
alone, so a passage gives the same anchors wherever it stands. A fingerprint holds, with their positions, the anchors whose hash is in the lowest of ``SHARE`` parts
of its range, so it grows with the text, and at least the ``SIZE`` of smallest hash; likeness counts the anchors in common that follow each
other in the same order in both texts, below the hash up to which both fingerprints are complete.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nosoflow.llm.common import LOWEST, mixed, part_of, range_bounds, texts

K, S, SIZE, SHARE = 16, 6, 64, 8
PART_BYTES = 16 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _windows(points: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each run of ``size`` values, by doubling the length covered."""
    hashes = {1: mixed(points.astype(np.uint64) + _ODD)}
    width = 1
    while 2 * width <= size:
        h = hashes[width]
        hashes[2 * width] = (h[:-width] ^ (h[:-width] >> np.uint64(32))) * _ODD + h[width:]
        width *= 2
    total, covered = hashes[width], width
    while covered < size:
        step = max(w for w in hashes if w <= size - covered)
        h = hashes[step][covered:]
        total = (total[:len(h)] ^ (total[:len(h)] >> np.uint64(31))) * _ODD + h
        covered += step
    return total


def _smallest(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` values."""
    width = 1
    while 2 * width <= size:
        values, width = np.minimum(values[:-width], values[width:]), 2 * width
    rest = size - width
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of a text's closed syncmers, in order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    inner = mixed(_windows(points, s))
    least = _smallest(inner, k - s + 1)
    chosen = np.flatnonzero((least == inner[:len(least)]) | (least == inner[k - s:]))
    # The k-mer's hash: its first, middle and last s-mers cover it.
    middle = inner[chosen + (k - s) // 2]
    value = mixed(mixed(inner[chosen] * _ODD + middle) * _ODD + inner[chosen + k - s])
    return chosen, (value >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str, k: int = K, s: int = S, size: int = SIZE, share: int = SHARE) -> str:
    """Anchors with a hash in the lowest of ``share`` parts, ``size`` at least, first position each, as 8 hex digits of hash and 8 of position.

    ``share`` 1 keeps all anchors. A text too short to have an anchor is one anchor of its own; the empty text has an empty fingerprint.
    """
    places, values = anchors(text, k, s)
    if not len(values):
        return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).hexdigest() + "0" * 8 if text else ""
    few = values < (1 << 32) // share
    if share > 1 and len(np.unique(values[few])) >= size:
        places, values = places[few], values[few]
        size = len(values)
    elif share == 1:
        size = len(values)
    values, first = np.unique(values, return_index=True)
    pairs = np.stack((values[:size], places[first[:size]].astype(np.uint32)), 1)
    return pairs.astype(">u4").tobytes().hex()


def _parsed(print_: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(bytes.fromhex(print_), ">u4").reshape(-1, 2).astype(np.int64)
    return pairs[:, 0], pairs[:, 1]


def _complete(hashes: np.ndarray, size: int, share: int) -> int:
    """Hash up to which a fingerprint holds all anchors of its text."""
    if len(hashes) < size:
        return 1 << 32
    return max(int(hashes[size - 1]), (1 << 32) // share - 1)


def likeness(a: str, b: str, size: int = SIZE, share: int = SHARE) -> float:
    """Twice the anchors in common over those of both, from 0 to 1, among the hashes up to which both fingerprints are complete.

    Anchors in common count if their positions rise in the same order (the longest such chain). Two empty texts are alike.
    """
    if a == b:
        return 1.0
    (hashes_a, places_a), (hashes_b, places_b) = _parsed(a), _parsed(b)
    last = min(_complete(hashes_a, size, share), _complete(hashes_b, size, share))
    within_a, within_b = int((hashes_a <= last).sum()), int((hashes_b <= last).sum())
    common, at_a, at_b = np.intersect1d(hashes_a[:within_a], hashes_b[:within_b], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    places_a, places_b = places_a[at_a], places_b[at_b]
    chain: list[int] = []
    for place in places_b[np.lexsort((places_b, places_a))].tolist():
        at = bisect_left(chain, place)
        chain[at:at + 1] = [place]
    return 2 * len(chain) / (within_a + within_b)


def edited(text: str, following: str) -> str:
    """``text`` with its last half, rounded down, replaced by as many first code points of ``following``, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_following(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id and text dealt to ranges of ids, each range in descending order and followed by a guest: the next range's first row.

    The last range's guest is the first row of all. Only the ids' ranges, one number each, and each range's largest id reach the driver.
    """
    source = texts(docs)
    bounds = range_bounds(source, "doc_id", part_bytes)
    part = part_of(bounds)
    key = F.coalesce("doc_id", F.lit(LOWEST))
    tops = source.select(part("doc_id").alias("part"), key.alias("key")).groupBy("part").agg(F.max("key").alias("top")).collect()
    tops = sorted((r.part, r.top) for r in tops)
    hosts = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}  # the range above reads on in this one

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def homes(keys: pa.Array) -> pa.Array:
        values = keys.fill_null(LOWEST).to_numpy(zero_copy_only=False)
        own = np.searchsorted(np.array(bounds, np.int64), values, side="right").tolist()
        guests = [hosts.get(v) for v in values.tolist()]
        return pa.array([[p] if g is None else [p, g] for p, g in zip(own, guests)], pa.list_(pa.int32()))

    dealt = source.select("doc_id", "text", F.posexplode(homes("doc_id")).alias("guest", "part"))
    dealt = dealt.repartitionById(len(bounds) + 1, "part")
    return dealt.sortWithinPartitions("part", "guest", F.desc("doc_id"), "text")


def fingerprints(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller id, after the smallest the largest; rows with the same id follow each other by text, and
    a row without an id comes last. A single document follows itself. Null texts are empty; an empty text's fingerprint is empty.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "guest"))
            for doc_id, text, guest in zip(*columns):
                own = fingerprint(text)
                if before is not None:
                    rows.append(_row(*before, text, own))
                before = None if guest else (doc_id, text, own)
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        assert before is None, "a range without a guest"

    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return with_following(docs, part_bytes).mapInArrow(read, _SCHEMA)


def _row(doc_id: int | None, text: str, own: str, following: str, next_print: str) -> tuple:
    changed = edited(text, following)
    print_ = own if changed == text else fingerprint(changed)
    digest = hashlib.sha256(changed.encode()).hexdigest()
    return doc_id, len(text), digest, own, print_, likeness(own, print_), likeness(own, next_print)
