"""Near duplicates by HyperMinHash: small registers, bands of them, a collision-corrected estimate, then exact sets.

1. A text's shingle hashes fall into buckets by their leading bits. Of each bucket's least hash a register keeps the number of leading zeros of its other bits and a few
   bits after the leading one. An empty bucket takes the register of the bucket that comes first in an order of its own, so that each
   register agrees with a probability of the Jaccard similarity, for short texts too.
2. Texts with equal sets form one class. Representatives meet in buckets by hashes of bands of registers; there the share of equal registers, less what chance
   collisions of the compressed values add, estimates the similarity, and pairs well below the threshold go no further. Connected components of the others are blocks.
3. Within a block, full shingle sets are compared in tiles; only links found there count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nosoflow.llm.common import BYTE_HASHES, byte_words, mixed, pieces_of, shingles, signed, stored, texts
from nosoflow.llm.components import components
from nosoflow.llm.jaccard import _SETS, _groups, _stars, _tile, _tiled, _verified

WORDS = 4
THRESHOLD = 0.8
RECALL = 0.99999
#: Registers of a band.
ROWS = 6
#: Buckets by the 8 leading bits of a hash; bits that hold the leading zeros of the rest (more of them count as the greatest number), and bits after the leading one.
BUCKET_BITS, ZERO_BITS, MANTISSA_BITS = 8, 4, 4
REGISTERS = 1 << BUCKET_BITS
#: Standard deviations below the threshold that still count in a bucket; members of a bucket that one task holds at a time, twice.
SLACK, BUCKET_TILE = 5.0, 1024


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` registers so that a pair at the threshold meets in one of them with probability ``recall``."""
    bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
    if bands * rows > REGISTERS:
        raise ValueError(f"a recall of {recall} at {threshold} takes {bands} bands of {rows}, more than {REGISTERS} registers")
    return bands


@cache
def _orders() -> np.ndarray:
    """For each register, the place of every bucket in the order in which an empty one asks them."""
    rng = np.random.default_rng(13)
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)]).astype(np.int16)


def registers(hashes: np.ndarray) -> np.ndarray:
    """One byte for each bucket of the sorted, different ``hashes``, of which there is one at least."""
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    taken, rest = bucket[first], hashes[first] & np.uint64((1 << 64 - BUCKET_BITS) - 1)
    part, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.minimum(64 - BUCKET_BITS - exponent, (1 << ZERO_BITS) - 1)
    mantissa = np.maximum((2 * part - 1) * (1 << MANTISSA_BITS), 0).astype(np.int64)
    out = np.zeros(REGISTERS, np.uint8)
    out[taken] = zeros << MANTISSA_BITS | mantissa
    if len(taken) < REGISTERS:
        empty = np.ones(REGISTERS, bool)
        empty[taken] = False
        empty = np.flatnonzero(empty)
        out[empty] = out[taken[_orders()[np.ix_(empty, taken)].argmin(axis=1)]]
    return out


@cache
def _collision_table() -> tuple[np.ndarray, np.ndarray]:
    """Probability that two unrelated least hashes share a register, by the binary logarithm of the hashes per bucket."""
    starts = np.arange(1 << MANTISSA_BITS) / (1 << MANTISSA_BITS)
    edges = [0.0]
    for zeros in range((1 << ZERO_BITS) - 1, -1, -1):
        low = 0.5 ** (zeros + 1)
        edges += [low * (1 + s) for s in starts if zeros < (1 << ZERO_BITS) - 1 or s > 0]
    edges = np.array([*edges, 1.0])
    loads = np.arange(-9.0, 24.0, 0.25)
    cells = np.exp(-np.outer(2.0**loads, edges[:-1])) - np.exp(-np.outer(2.0**loads, edges[1:]))
    return loads, (cells**2).sum(axis=1) / cells.sum(axis=1) ** 2


def estimated(equal: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Jaccard similarities from numbers of equal registers and the mean sizes of the two sets, corrected for chance collisions."""
    chance = np.interp(np.log2(np.maximum(sizes, 1) / REGISTERS), *_collision_table())
    return (equal / REGISTERS - chance) / (1 - chance)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different ``words``-word shingles; of all words if there are fewer."""
    return np.unique(shingles(BYTE_HASHES.of(byte_words(text, lower=True)), words))


def _features(words: int, bands: int):
    weights = mixed(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    salts = mixed(np.arange(bands, dtype=np.uint64) + np.uint64(1 << 21))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1024):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                grams = shingle_set(text, words)
                if not len(grams):
                    rows.append((doc_id, None, None, 0, None, None))
                    continue
                k1, k2 = np.frombuffer(xxhash.xxh128_digest(grams.tobytes()), np.int64).tolist()
                held = registers(grams)
                band = (held[:bands * ROWS].reshape(bands, ROWS).astype(np.uint64) * weights).sum(axis=1)
                rows.append((doc_id, k1, k2, len(grams), signed(mixed(band + salts)), held.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "k1", "k2", "size", "bands", "registers"])

    return features


_FEATURES = "doc_id bigint, k1 bigint, k2 bigint, size bigint, bands array<bigint>, registers binary"


def _bucket_stars(least: float):
    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, tails = [], []
        for group in _groups(batches, ["key", "t1", "t2"]):
            ids, sizes = group.column("rep").to_numpy(), group.column("size").to_numpy()
            if len(ids) < 2:
                continue
            held = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint8).reshape(len(ids), REGISTERS)
            equal = np.stack([np.count_nonzero(held == one, axis=1) for one in held])
            a, b = _stars(ids, estimated(equal, (sizes[:, None] + sizes[None, :]) / 2) >= least)
            if len(a):
                heads.append(a)
                tails.append(b)
            if len(heads) >= 4096:
                yield pa.record_batch([pa.array(np.concatenate(heads)), pa.array(np.concatenate(tails))], names=["a", "b"])
                heads, tails = [], []
        if heads:
            yield pa.record_batch([pa.array(np.concatenate(heads)), pa.array(np.concatenate(tails))], names=["a", "b"])

    return stars


def candidate_stars(classes: DataFrame, threshold: float) -> DataFrame:
    """a, b: links that tie together the representatives whose registers agree well enough in some bucket of a band."""
    rows = classes.select("rep", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = rows.join(buckets, "key").withColumn("parts", F.ceil(F.col("members") / BUCKET_TILE))
    met = met.join(classes.select("rep", "size", "registers"), "rep").withColumn("t", _tile("rep", "parts"))
    # A row of tile t goes to the tasks (t, u) and (u, t) of its bucket; a bucket that is no larger than a tile is one task.
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    met = met.withColumn("u", other).select("key", F.least("t", "u").alias("t1"), F.greatest("t", "u").alias("t2"), "rep", "size", "registers")
    least = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / REGISTERS)
    dealt = met.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2", "rep")
    return dealt.mapInArrow(_bucket_stars(least), "a bigint, b bigint").distinct()


def _sets(words: int):
    """A text's shingle set, once for each pair of tiles that it is compared in."""
    names = [x.split()[0] for x in _SETS.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.bool_(), pa.binary()]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            rows = []
            for row in batch.to_pylist():
                grams = shingle_set(row["text"], words).tobytes()
                rows += [(row["block"], u["s1"], u["t1"], u["s2"], u["t2"], row["rep"], row["copies"], u["first"], grams) for u in row["units"]]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return sets


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set holds its different ``words``-word shingles (A to Z lower case; words between ASCII blanks), all words as one shingle if there are fewer.
    Two documents are linked if intersection over union is ``threshold`` or more; ``component_id`` is the smallest id that links lead to, the own one
    included, and the document of that id is kept. A null text, an empty one and one without words have no shingles and no links. A pair at the threshold is found
    with probability ``recall``, more similar ones more likely; every link is confirmed on the full sets. Repeated rows are one document; an id
    with several texts has the links of all and the size of the largest set. Rows without an id are left apart, each with a null component, and kept.
    """
    bands = bands_for(threshold, recall)
    rows = texts(docs)
    source = rows.where("doc_id IS NOT NULL")
    features = stored(source.mapInArrow(_features(words, bands), _FEATURES), "features")
    documents = features.where("size > 0").select("doc_id", "k1", "k2").distinct()
    classes = stored(features.where("size > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("size").alias("size")), "classes")
    firsts = features.where("size > 0").select(F.col("doc_id").alias("rep"), "k1", "k2", "size", "bands", "registers").dropDuplicates(["rep", "k1", "k2"])
    represented = firsts.join(classes.select("rep", "k1", "k2"), ["rep", "k1", "k2"], "left_semi")

    stars = candidate_stars(represented, threshold)
    roots = stored(components(stars, "blocks").select(F.col("node").alias("rep"), F.col("root").alias("block")), "roots")
    blocked = roots.union(roots.select(F.col("block").alias("rep"), "block").distinct())
    members = classes.groupBy("rep").agg(F.max("size").alias("size")).withColumn("copies", F.lit(1).cast("bigint")).join(blocked, "rep")

    sets = source.join(_tiled(members, threshold), F.col("doc_id") == F.col("rep")).drop("doc_id").mapInArrow(_sets(words), _SETS)
    compared = sets.repartition("block", "s1", "t1", "s2", "t2").sortWithinPartitions("block", "s1", "t1", "s2", "t2", "rep")
    verified = compared.mapInArrow(_verified(threshold), "rep bigint, links bigint, root bigint")

    # An id with several texts ties together the classes of all of them.
    owned = stored(documents.join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select("doc_id", "rep").distinct(), "documents")
    several = owned.groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most"))
    ties = owned.join(several.where("least < most"), "doc_id").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    linked = verified.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(ties)
    grouped = components(linked, "links").withColumnRenamed("node", "least")
    found = several.join(grouped, "least", "left").select("doc_id", F.coalesce("root", "least").alias("component_id"))
    sized = features.groupBy("doc_id").agg(F.max("size").alias("n_shingles"))
    known = sized.join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    nameless = rows.where("doc_id IS NULL").mapInArrow(_features(words, bands), _FEATURES).select("doc_id", F.col("size").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"))
    return known.unionByName(nameless).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
