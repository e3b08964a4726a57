"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts, are learned from labelled rows, with modified discounts for counts of 1, 2 and more. Of a bigram and of a word,
what is counted are the different words before it, so copies of a text count once. A word's probability in a class backs off to the shared counts, the
different words before it in all documents, which both classes use; a bigram's backs off to the word's. Every expression of the rows learned from is
kept. ``plain`` is the difference of the two log-likelihoods per word of these models.

Over all expressions that difference is mostly noise of rare ones, so the score weighs it. How far the classes' own estimates are believed depends on how many
counts there are: a geometric mean, weighted by the probability that the classes differ there at all, leads from the shared back-off to the class's own
estimate. A toxic text is taken as an ordinary one with a share of words from the toxic model; the score is a logistic function of the difference of
the log-likelihoods of that mixture and of the ordinary model per word.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nosoflow.llm.common import estimated_bytes, id_crc, make_room, mixed, pieces_of, stored, word_hashes, words

#: Expected number of labelled rows learned from, for each label, drawn by a hash of their ids, and of the characters that they hold at most.
FIT_ROWS = 20_000
FIT_CHARS = 12_000_000
#: Share of a toxic text's words that the toxic model explains.
MIXED = 0.01
THRESHOLD = 0.3
#: Words taken together by a task before they are sorted, and when texts are scored.
GATHER, SCORED = 500_000, 100_000
_BINS = 100_000.0
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.int64(-1)


class Numbers(dict):
    """Number of each word: its place among the sorted hashes of a vocabulary, or, for any other word, a negative number of 62 bits of its hash.

    The first ``limit`` words of the vocabulary that come are remembered, so the frequent ones are; others, which are many and rare, are looked up each time.
    """

    def __init__(self, vocabulary: np.ndarray, limit: int = 200_000):
        super().__init__()
        make_room()
        self.limit = limit
        self.known = memoryview(np.ascontiguousarray(vocabulary))

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        at = bisect_left(self.known, value)
        if at < len(self.known) and self.known[at] == value:
            if len(self) < self.limit:
                self[word] = at
            return at
        return -2 - (value >> 2)

    def of(self, text: str | None) -> np.ndarray:
        found = words(text or "")
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def _befores(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number before each one, ``_FIRST`` at the starts of texts."""
    out = np.empty_like(numbers)
    out[1:] = numbers[:-1]
    out[starts] = _FIRST
    return out


def packed(values: np.ndarray) -> bytes:
    """Whole numbers of 0 and more in as few bytes as each needs: the lengths in bytes, then the bytes."""
    data = np.ascontiguousarray(values, np.uint64)
    lengths = np.ones(len(data), np.uint8)
    for size in range(1, 8):
        lengths += data >= np.uint64(1 << 8 * size)
    planes = data.astype("<u8").view(np.uint8).reshape(-1, 8)
    return lengths.tobytes() + planes[np.arange(8) < lengths[:, None]].tobytes()


def unpacked(data: bytes | pa.Buffer, count: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8) if count else np.zeros(0, np.uint8)
    planes = np.zeros((count, 8), np.uint8)
    planes[np.arange(8) < raw[:count, None]] = raw[count:]
    return planes.view("<u8").reshape(-1).astype(np.int64)


def _gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=0)


@dataclass
class Model:
    """Sorted hashes of the words, log ratios of words and bigrams, and the logistic function's two numbers.

    ``pairs`` are (number of the first word + 1) * len(words) + number of the second, sorted; the first word of a text follows number -1. ``back`` has
    the log ratio of the back-off weights after each word, ``unseen`` that of a word outside the vocabulary; ``plain`` values are those of the models
    alone, ``gain`` values those that the score uses.
    """

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    word_gain: np.ndarray = field(default_factory=lambda: np.zeros(0))
    word_plain: np.ndarray = field(default_factory=lambda: np.zeros(0))
    back: np.ndarray = field(default_factory=lambda: np.zeros(1))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pair_gain: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    pair_plain: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    unseen: float = 0.0
    slope: float = 0.0
    offset: float = -50.0

    @cached_property
    def numbers(self) -> Numbers:
        return Numbers(self.words)

    @cached_property
    def _mixed_words(self) -> np.ndarray:
        return np.log1p(MIXED * np.expm1(self.word_gain))

    @cached_property
    def _mixed_pairs(self) -> np.ndarray:
        return np.log1p(MIXED * np.expm1(self.pair_gain.astype(np.float32)))

    def __getstate__(self) -> dict:
        """Workers get what texts are measured with, not the log ratios that this comes from."""
        state = {k: v for k, v in self.__dict__.items() if k != "numbers"}
        return {**state, "word_gain": None, "pair_gain": None, "_mixed_words": self._mixed_words, "_mixed_pairs": self._mixed_pairs}

    def measured(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the mixture's log-likelihood less the ordinary one, and the toxic one less the ordinary one, per word; 0 without words."""
        parts = [self.numbers.of(t) for t in texts]
        lengths = np.array([len(p) for p in parts], np.int64)
        if not len(self.words) or not lengths.sum():
            return np.zeros(len(texts)), np.zeros(len(texts))
        numbers = np.concatenate(parts)
        filled = np.flatnonzero(lengths)
        starts = (np.cumsum(lengths) - lengths)[filled]
        left, known = _befores(numbers, starts), numbers >= 0
        inner = np.where(known, numbers, 0)
        score = np.where(known, self._mixed_words[inner], 0.0)
        plain = np.where(known, self.word_plain[inner], self.unseen) + np.where(left >= _FIRST, self.back[np.maximum(left, -1) + 1], 0.0)
        both = np.flatnonzero(known & (left >= _FIRST))
        keys, places = np.unique((left[both] + 1) * len(self.words) + numbers[both], return_inverse=True)
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        hit = (self.pairs[at] == keys)[places]
        both, at = both[hit], at[places[hit]]
        score[both], plain[both] = self._mixed_pairs[at], self.pair_plain[at]
        out = np.zeros((2, len(texts)))
        out[0, filled], out[1, filled] = np.add.reduceat(score, starts), np.add.reduceat(plain, starts)
        out /= np.maximum(lengths, 1)
        return out[0], out[1]

    def gap(self, text: str | None) -> float:
        return float(self.measured([text])[0][0])

    def score(self, gap: np.ndarray | float) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.offset + self.slope * np.asarray(gap), -60.0, 60.0)))


def labelled_rows(labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """doc_id, toxic, checks of the rows to learn from, ``fit_rows`` expected for each label at most, and the share drawn of each.

    Rows whose id's crc32 leaves 2 modulo 4 are not used; those that leave 3 only fit the logistic function (``checks``). An id
    with several labels is toxic if one of them says so.
    """
    crc = id_crc(F.col("doc_id"), 4)
    rows = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    rows = rows.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(crc != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    shares = {c: min(1.0, fit_rows / n) for c, n in counts.items()}
    limit = F.when(F.col("toxic") == 1, int(shares.get(1, 0) * (1 << 30))).otherwise(int(shares.get(0, 0) * (1 << 30)))
    return rows.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 30)) < limit).withColumn("checks", crc == 3), shares


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> tuple[DataFrame, dict[int, float]]:
    """text, toxic, checks of the rows to learn from, stored, and the share drawn of each label.

    The drawn ids are at most about twice ``fit_rows``, so they are broadcast. If their texts hold more than ``fit_chars`` characters of a label, they are thinned by another hash.
    """
    sample, shares = labelled_rows(labels, fit_rows)
    ids = docs["doc_id"].cast("bigint")
    rows = docs.select(ids.alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(stored(sample, "labelled")), "doc_id")
    rows = stored(rows, "training")
    sizes = {r.toxic: r.n or 0 for r in rows.groupBy("toxic").agg(F.sum(F.length("text")).alias("n")).collect()}
    thinned = {c: fit_chars / n for c, n in sizes.items() if n > fit_chars}
    for label, share in thinned.items():
        rows = rows.where((F.col("toxic") != label) | (F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    return rows.select("text", "toxic", "checks"), {c: s * thinned.get(c, 1.0) for c, s in shares.items()}


def _vocabulary(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of all words of ``rows``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of([batch], 1024):
                hashes = [word_hashes(t or "") for t in part.column("text").to_pylist()]
                yield pa.record_batch([pa.array(np.unique(np.concatenate(hashes)).view(np.int64) if hashes else np.zeros(0, np.int64))], names=["w"])

    found = rows.select("text").mapInArrow(gather, "w bigint").distinct().toArrow()
    return np.sort(found.column("w").to_numpy().view(np.uint64))


def _gathered(batches: Iterator[pa.RecordBatch], numbers: Numbers, limit: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Labels, numbers and starts of texts with words, of about ``limit`` words at a time."""
    labels, parts, size = [], [], 0

    def together() -> tuple[list, np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in parts])
        return labels, np.concatenate(parts), np.cumsum(lengths) - lengths

    for batch in batches:
        marks = batch.column("toxic").to_pylist() if "toxic" in batch.schema.names else [None] * batch.num_rows
        for text, label in zip(batch.column("text"), marks):
            found = numbers.of(text.as_py())
            if not len(found):
                continue
            if size and size + len(found) > limit:
                yield together()
                labels, parts, size = [], [], 0
            labels.append(label)
            parts.append(found)
            size += len(found)
    if parts:
        yield together()


def _pair_counts(rows: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted bigrams of ``rows`` and, for ordinary and toxic texts, after how many different words each stands. Copies of a text so count once."""
    size = len(vocabulary)
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    buckets = 2 * rows.sparkSession.sparkContext.defaultParallelism

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for labels, numbers, starts in _gathered(batches, Numbers(shared.value), GATHER):
            left = _befores(numbers, starts)
            before = _befores(left, starts)
            label = np.repeat(np.array(labels, np.int64), np.diff(np.append(starts, len(numbers))))
            key = ((left + 1) * size + numbers) * 2 + label
            order = np.lexsort((before, key))
            key, before = key[order], before[order] + 1
            fresh = np.append(True, (key[1:] != key[:-1]) | (before[1:] != before[:-1]))
            key, before = key[fresh], before[fresh]
            home = (mixed((key >> 1).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            for b in range(buckets):
                some = home == b
                if some.any():
                    yield pa.record_batch([pa.array([b], pa.int32()), pa.array([int(some.sum())]), pa.array([packed(_gaps(key[some]))]), pa.array([packed(before[some])])], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, befores = [], []
        for batch in batches:
            for n, k, u in zip(*(batch.column(c).to_pylist() for c in names[1:])):
                keys.append(np.cumsum(unpacked(k, n)))
                befores.append(unpacked(u, n))
        if keys:
            key, before = np.concatenate(keys), np.concatenate(befores)
            order = np.lexsort((before, key))
            key, before = key[order], before[order]
            fresh = np.append(True, (key[1:] != key[:-1]) | (before[1:] != before[:-1]))
            key = key[fresh]
            pair, at = np.unique(key >> 1, return_inverse=True)
            counts = [np.bincount(at[(key & 1) == c], minlength=len(pair)).astype(np.int32) for c in (0, 1)]
            yield pa.record_batch([pa.array(pair), *map(pa.array, counts)], names=["pair", "c0", "c1"])

    names = ["bucket", "n", "keys", "befores"]
    dealt = rows.select("text", "toxic").mapInArrow(deal, "bucket int, n bigint, keys binary, befores binary").repartitionById(buckets, "bucket")
    found = stored(dealt.mapInArrow(count, "pair bigint, c0 int, c1 int"), "pairs").toArrow()
    shared.destroy()
    order = np.argsort(found.column("pair").to_numpy())
    return tuple(found.column(c).to_numpy()[order] for c in ("pair", "c0", "c1"))


def _corpus_counts(docs: DataFrame, vocabulary: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """How many different words each of the sorted hashes ``vocabulary`` follows in all documents, and the number of all different bigrams.

    A task sends a bigram once for about ``GATHER`` words. Bigrams of two known words are sorted numbers and cost their gaps, two or three bytes; others have a
    hash of 64 bits. A word's bigrams share a bucket; those of the sorted ``common`` words are dealt over all.
    """
    size = len(vocabulary)
    buckets = max(2 * docs.sparkSession.sparkContext.defaultParallelism, estimated_bytes(docs.select("text")) >> 23)
    often = np.zeros(size + 1, bool)
    often[np.searchsorted(vocabulary, common)] = True
    often[size] = True
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, often))

    def homes(right: np.ndarray, key: np.ndarray, spread: np.ndarray) -> np.ndarray:
        return np.where(spread[right], (mixed(key) % np.uint64(buckets)).astype(np.int64), right * buckets // (size + 1))

    def sorted_keys(numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys (second word, first word + 1) of bigrams of known words; hashes of the others and their second words, ``size`` if unknown."""
        left = _befores(numbers, starts)
        both = (numbers >= 0) & (left >= _FIRST)
        known = np.unique(numbers[both] * (size + 1) + left[both] + 1)
        hashed, first = np.unique(mixed(left[~both].view(np.uint64) * _GOLD + numbers[~both].view(np.uint64)), return_index=True)
        right = numbers[~both][first]
        return known, hashed, np.where(right >= 0, right, size)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, spread = shared.value
        for _, numbers, starts in _gathered(batches, Numbers(vocabulary), GATHER):
            known, hashed, right = sorted_keys(numbers, starts)
            here, there = homes(known // (size + 1), known.view(np.uint64), spread), homes(right, hashed, spread)
            here_order, there_order = np.argsort(here, kind="stable"), np.lexsort((hashed, right, there))
            here_cuts = np.searchsorted(here[here_order], np.arange(buckets + 1))
            there_cuts = np.searchsorted(there[there_order], np.arange(buckets + 1))
            for b in range(buckets):
                mine, other = here_order[here_cuts[b]:here_cuts[b + 1]], there_order[there_cuts[b]:there_cuts[b + 1]]
                if len(mine) or len(other):
                    columns = ([b], [len(mine)], [packed(_gaps(known[mine]))], [len(other)], [packed(_gaps(right[other]))], [hashed[other].tobytes()])
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        keys, hashes, rights, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0

        def merge() -> None:
            """Sorts in place, so that a task holds its bigrams twice at most."""
            both = np.concatenate(keys)
            keys.clear()
            both.sort()
            keys.append(both[np.append(True, both[1:] != both[:-1])] if len(both) else both)
            unique, first = np.unique(np.concatenate(hashes), return_index=True)
            hashes[:], rights[:] = [unique], [np.concatenate(rights)[first]]

        for batch in batches:
            columns = [batch.column(c) for c in names[1:]]
            for row in range(batch.num_rows):
                n, k, m, r, h = (c[row] for c in columns)
                n, m = n.as_py(), m.as_py()
                keys.append(np.cumsum(unpacked(k.as_buffer(), n)))
                rights.append(np.cumsum(unpacked(r.as_buffer(), m)))
                hashes.append(np.frombuffer(h.as_buffer(), np.uint64) if m else np.zeros(0, np.uint64))
                waiting += n + m
                if waiting > 2 * GATHER:
                    merge()
                    waiting = 0
        merge()
        seconds = keys.pop() // (size + 1)  # ascending
        at = np.flatnonzero(np.append(True, seconds[1:] != seconds[:-1])) if len(seconds) else np.zeros(0, np.int64)
        yield pa.record_batch([pa.array(seconds[at]), pa.array(np.diff(np.append(at, len(seconds))))], names=["i", "n"])
        found, n = np.unique(rights[0], return_counts=True)
        yield pa.record_batch([pa.array(found), pa.array(n)], names=["i", "n"])

    names = ["bucket", "n", "keys", "m", "rights", "hashes"]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    dealt = docs.select("text").mapInArrow(deal, "bucket int, n bigint, keys binary, m bigint, rights binary, hashes binary").repartitionById(buckets, "bucket")
    rows = dealt.mapInArrow(count, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    sums = np.zeros(size + 1, np.int64)
    sums[rows.column("i").to_numpy()] = rows.column("n").to_numpy()
    return sums[:-1], int(sums.sum())


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts of 0, 1, 2 and more, from how many counts are 1, 2, 3 and 4."""
    n = [int((counts == k).sum()) for k in range(1, 5)]
    if not n[0] or not n[1]:
        return np.array([0.0, 0.5, 0.75, 0.75])
    y = n[0] / (n[0] + 2 * n[1])
    own = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.75 for k in (1, 2, 3)]
    return np.array([0.0, *(min(0.95 * k, max(0.1, d)) for k, d in zip((1, 2, 3), own))])


def _cut(counts: np.ndarray, by: np.ndarray) -> np.ndarray:
    return by[np.minimum(counts, 3)]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1, by Stirling's series at x + 8."""
    y = x + 8.0
    steps = sum(np.log(x + i) for i in range(8))
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - steps


def _evidence(n0: np.ndarray, n1: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logarithm of how much likelier counts of an expression are if its toxic share may be any than if it is ``toxic``."""
    free = _log_gamma(n0 + 1.0) + _log_gamma(n1 + 1.0) - _log_gamma(n0 + n1 + 2.0)
    return free - n1 * np.log(toxic) - n0 * np.log1p(-toxic)


def _prior(evidence: np.ndarray, counts: np.ndarray) -> float:
    """Log odds that an expression differs between the classes, most likely for these values of the evidence (expectation maximisation)."""
    share = 0.01
    for _ in range(500):
        after = float((_logistic(evidence + np.log(share / (1 - share))) * counts).sum() / counts.sum())
        after = min(0.5, max(1e-9, after))
        if abs(after - share) < 1e-9:
            break
        share = after
    return float(np.log(share / (1 - share)))


def _differs(evidence: np.ndarray, places: int) -> np.ndarray:
    """Probability that each expression differs between the classes; for the prior, evidence is rounded to 1 / ``places``."""
    values, counts = np.unique(np.round(evidence * places), return_counts=True)
    return _logistic(evidence + _prior(values / places, counts))


def learned(vocabulary: np.ndarray, pair: np.ndarray, c0: np.ndarray, c1: np.ndarray, shared: np.ndarray) -> Model:
    """The model of bigrams ``pair`` and their counts in both classes. ``shared`` has the words' share of all different bigrams of the corpus."""
    size = len(vocabulary)
    left, right = pair // size, pair % size
    seen = [np.bincount(right[c > 0], minlength=size) for c in (c0, c1)]  # different words before each word
    by = discounts(seen[0] + seen[1])
    total = [float(t.sum()) for t in seen]
    lower = [float(_cut(t, by).sum()) / n for t, n in zip(seen, total)]
    own = [(t - _cut(t, by)) / n + w * shared for t, n, w in zip(seen, total, lower)]

    evidence = _evidence(*(t.astype(float) for t in seen), np.full(size, total[1] / (total[0] + total[1])))
    differs = _differs(evidence, 100)
    chance = [shared ** (1 - differs) * p ** differs for p in own]

    by = discounts(c0 + c1)
    contexts = [np.bincount(left, c, size + 1) for c in (c0, c1)]
    spare = [np.bincount(left, _cut(c, by), size + 1) for c in (c0, c1)]
    back = [np.where(n > 0, s / np.maximum(n, 1), 1.0) for s, n in zip(spare, contexts)]

    def paired(p: list[np.ndarray]) -> np.ndarray:
        """Log ratio of the bigrams, backed off to the words' probabilities ``p``."""
        both = [np.where(n[left] > 0, (c - _cut(c, by)) / np.maximum(n[left], 1), 0.0) + w[left] * q[right] for c, n, w, q in zip((c0, c1), contexts, back, p)]
        return np.log(both[1] / both[0])

    sums = [float(c.sum()) for c in (c0, c1)]
    toxic = sums[1] * chance[1][right] / (sums[0] * chance[0][right] + sums[1] * chance[1][right])
    believed = _differs(_evidence(c0.astype(float), c1.astype(float), toxic), 20)
    word_gain = np.log(chance[1] / chance[0])
    pair_gain = word_gain[right] + believed * (paired(chance) - word_gain[right])
    return Model(
        vocabulary, word_gain, np.log(own[1] / own[0]), np.log(back[1] / back[0]), pair, pair_gain.astype(np.float32), paired(own).astype(np.float32),
        float(np.log(lower[1] / lower[0])))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Shared counts come from all documents. The texts learned from are bounded by ``fit_rows`` and ``fit_chars`` for each label, so their words and bigrams, at most one
    for two characters, reach the driver and are broadcast. Without rows of both labels nothing is learned and every score is 0.
    """
    rows, shares = training_rows(docs, labels, fit_rows, fit_chars)
    if set(shares) != {0, 1}:
        return Model()
    counted = rows.where("NOT checks")
    vocabulary = _vocabulary(counted)
    pair, c0, c1 = _pair_counts(counted, vocabulary) if len(vocabulary) else (np.zeros(0, np.int64),) * 3
    if not c0.any() or not c1.any():
        return Model()
    types = np.bincount(pair % len(vocabulary), minlength=len(vocabulary))
    counts, total = _corpus_counts(docs, vocabulary, vocabulary[types >= 1e-4 * len(pair)])
    return _calibrated(learned(vocabulary, pair, c0, c1, counts / total), rows.where("checks"), shares)


def _calibrated(model: Model, rows: DataFrame, shares: dict[int, float]) -> Model:
    """The model with a logistic function fitted on rows that its counts don't hold, weighted back to their share of all labelled rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    place = F.least(F.greatest(F.round(measures(shared)("text")["gap"] * _BINS), F.lit(-_BINS)), F.lit(10 * _BINS))  # at most one place for each row that checks
    bins = rows.select("toxic", place.alias("place")).groupBy("toxic", "place").count().collect()
    shared.destroy()  # its copies on the executors' disks go before the fitted model is sent
    x = np.array([r.place / _BINS for r in bins])
    y = np.array([float(r.toxic) for r in bins])
    n = np.array([r["count"] / shares[r.toxic] for r in bins])
    if len(set(y)) < 2:
        return Model()
    scale = max(float(np.sqrt((n * x * x).sum() / n.sum())), 1e-6)
    inputs = np.stack([np.ones(len(x)), x / scale], 1)
    beta = np.zeros(2)
    for _ in range(100):  # Newton steps with a small penalty, so that separable classes give finite numbers
        p = 1 / (1 + np.exp(-np.clip(inputs @ beta, -30, 30)))
        slope = inputs.T @ (n * (p - y)) + np.array([0.0, 1e-2]) * beta
        curve = (inputs * (n * p * (1 - p))[:, None]).T @ inputs + np.diag([1e-6, 1e-2])
        step = np.linalg.solve(curve, slope)
        beta -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    model.offset, model.slope = float(beta[0]), float(beta[1] / scale)
    return model


def measures(shared):
    """Column function of a broadcast model: text to struct(score, gap, plain), as ``Model.measured`` gives them."""

    @F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("score", "gap", "plain")]))
    def measure(texts: pa.Array) -> pa.Array:
        model, gaps, plains, waiting, size = shared.value, [np.zeros(0)], [np.zeros(0)], [], 0
        for value in [*texts, None]:
            text = value.as_py() if value is not None else None
            if waiting and (value is None or size + len(text or "") > 6 * SCORED):
                gap, plain = model.measured(waiting)
                gaps.append(gap)
                plains.append(plain)
                waiting, size = [], 0
            if value is not None:
                waiting.append(text)
                size += len(text or "")
        gap, plain = np.concatenate(gaps), np.concatenate(plains)
        return pa.StructArray.from_arrays([pa.array(model.score(gap)), pa.array(gap), pa.array(plain)], ["score", "gap", "plain"])

    return measure


def score_documents(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, log_ratio.

    ``score`` is that of the mixture: how much likelier a text is as one with a share ``MIXED`` of words from the toxic model, the classes' estimates weighed by
    their evidence. ``log_ratio`` is the plain difference of the two models' log-likelihoods per word, which the score does not use by itself. A text
    without words, null or empty, has equal likelihoods, a ratio of 0, and gets the logistic function's value there. Rows without an id are held out.
    Repeated rows get equal scores. Only doc_id and text are read; labels serve to learn alone.
    """
    model = model or fit(docs, labels)
    held = F.coalesce(id_crc(F.col("doc_id"), 4) == 2, F.lit(True)).alias("held_out")
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    measured = rows.withColumn("answer", measures(docs.sparkSession.sparkContext.broadcast(model))("text"))
    score = F.col("answer.score")
    return measured.select("doc_id", held, score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), F.col("answer.plain").alias("log_ratio"))


def keep_ordinary(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows predicted toxic. All columns stay."""
    name = "_".join(["answer", *docs.columns])
    answer = measures(docs.sparkSession.sparkContext.broadcast(model))(docs["text"])
    return docs.withColumn(name, answer).where(F.col(f"`{name}`.score") < THRESHOLD).drop(name)
