"""Similarity join of texts on their sets of word n-grams, by MinHash banding.

1. Texts with equal sets form one class, which only its first document represents from here on.
2. Representatives meet in buckets by hashes of signature bands. Inside a bucket, the share of equal signature values tells which of
   them are worth a comparison; a star of links ties these together. Connected components of the stars are blocks: two texts
   that are similar enough are in one block, but for the chance that the target recall allows.
3. Within a block, full n-gram sets are compared. A block of many members is cut into tiles by set size and hash; a task compares two tiles. It returns
   counts of links and a star for each group found, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nosoflow.llm.common import mixed, pieces_of, shingles, signed, stored, texts, word_hashes
from nosoflow.llm.components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
ROWS = 8
#: Signature bytes compared in buckets, and how many standard deviations below the threshold still count.
SKETCH, SLACK = 256, 5.0
#: Members of a bucket, and of a block, that one task holds at a time, twice.
BUCKET_TILE, TILE = 1024, 512


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` values so that a pair at the threshold meets in one of them with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _permutations(count: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    draws = np.random.default_rng(seed).integers(0, 1 << 32, (2, count), np.uint64).astype(np.uint32)
    return draws[0] | np.uint32(1), draws[1]


def signature(values: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Minimum of each of many permutations of the 32-bit values."""
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(values), 512):
        part = factors[:, None] * values[None, start:start + 512] + terms[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def _features(words: int, bands: int, rows: int):
    factors, terms = _permutations(max(bands * rows, SKETCH))
    weights = mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    salts = mixed(np.arange(bands, dtype=np.uint64) + np.uint64(1 << 20))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1024):
            ids, k1, k2, sizes, keys, sketches = [], [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                grams = np.unique(shingles(word_hashes(text), words))
                ids.append(doc_id)
                sizes.append(len(grams))
                if not len(grams):
                    for column in (k1, k2, keys, sketches):
                        column.append(None)
                    continue
                digest = np.frombuffer(xxhash.xxh128_digest(grams.tobytes()), np.int64)
                k1.append(int(digest[0]))
                k2.append(int(digest[1]))
                least = signature((grams >> np.uint64(32)).astype(np.uint32), factors, terms)
                band = (least[:bands * rows].reshape(bands, rows).astype(np.uint64) * weights).sum(axis=1)
                keys.append(signed(mixed(band + salts)))
                sketches.append((least[:SKETCH] & np.uint32(255)).astype(np.uint8).tobytes())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            columns = (ids, k1, k2, sizes, keys, sketches)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "k1", "k2", "size", "bands", "sketch"])

    return features


_FEATURES = "doc_id bigint, k1 bigint, k2 bigint, size bigint, bands array<bigint>, sketch binary"


def _rooted(linked: np.ndarray) -> np.ndarray:
    """Least index that each row of a symmetric matrix reaches."""
    labels = np.arange(len(linked))
    while True:
        least = np.where(linked, labels[None, :], len(labels)).min(axis=1, initial=len(labels))
        least = np.minimum(labels, least)
        least = least[least]
        if (least == labels).all():
            return labels
        labels = least


def _stars(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    roots = _rooted(linked)
    other = roots != np.arange(len(ids))
    return ids[other], ids[roots[other]]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, which follow each other; only one group and one batch are held."""
    held: list[pa.RecordBatch] = []
    owner = None
    for batch in batches:
        columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], 1)
        starts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1).tolist(), len(columns)]
        for start, end in zip(starts, starts[1:]):
            if start == end:
                continue
            key = tuple(columns[start].tolist())
            if held and key != owner:
                yield pa.Table.from_batches(held)
                held = []
            owner = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _bucket_stars(least_share: float):
    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, tails, count = [], [], 0
        for group in _groups(batches, ["key", "t1", "t2"]):
            ids = group.column("rep").to_numpy()
            if len(ids) < 2:
                continue
            sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
            if len(ids) == 2:
                linked = np.count_nonzero(sketches[0] == sketches[1]) >= least_share * SKETCH
                a, b = (ids[1:], ids[:1]) if linked else (ids[:0], ids[:0])
            else:
                equal = np.stack([np.count_nonzero(sketches == s, axis=1) for s in sketches])
                a, b = _stars(ids, equal >= least_share * SKETCH)
            if len(a):
                heads.append(a)
                tails.append(b)
                count += len(a)
            if count > 50_000:
                yield pa.record_batch([pa.array(np.concatenate(heads)), pa.array(np.concatenate(tails))], names=["a", "b"])
                heads, tails, count = [], [], 0
        if heads:
            yield pa.record_batch([pa.array(np.concatenate(heads)), pa.array(np.concatenate(tails))], names=["a", "b"])

    return stars


def _tile(rep: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(rep), F.col(parts))


def candidate_stars(classes: DataFrame, threshold: float) -> DataFrame:
    """a, b: links that tie together the representatives whose signatures agree well enough in some bucket."""
    rows = classes.select("rep", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = rows.join(buckets, "key").withColumn("parts", F.ceil(F.col("members") / BUCKET_TILE))
    met = met.join(classes.select("rep", "sketch"), "rep").withColumn("t", _tile("rep", "parts"))
    # A row of tile t goes to the tasks (t, u) and (u, t) of its bucket; a bucket that is no larger than a tile is one task.
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    met = met.withColumn("u", other).select("key", F.least("t", "u").alias("t1"), F.greatest("t", "u").alias("t2"), "rep", "sketch")
    share = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / SKETCH)
    dealt = met.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2", "rep")
    return dealt.mapInArrow(_bucket_stars(share), "a bigint, b bigint").distinct()


def _tiled(members: DataFrame, threshold: float) -> DataFrame:
    """rep, copies, block, units: for each member of a block the pairs of tiles (s1, t1, s2, t2, first) that it is compared in.

    Sets that are similar enough differ in size by 1 / threshold at most, so a large block's tiles are of one size step and are compared
    with those of the same and of the next step only.
    """
    sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("members"))
    rows = members.join(sizes, "block")
    step = F.when(F.col("members") > TILE, F.floor(F.log(F.col("size")) / F.lit(-math.log(threshold) * 1.0001))).otherwise(F.lit(0)).cast("bigint")
    rows = stored(rows.select("block", "rep", "copies", step.alias("step"), "members"), "blocks")
    parts = rows.groupBy("block", "step").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts"))
    own = rows.join(parts, ["block", "step"]).withColumn("t", _tile("rep", "parts"))
    zero = F.lit(0).cast("bigint")
    all_of = lambda c: F.explode(F.sequence(zero, F.col(c) - 1))
    keep = ["block", "rep", "copies"]
    same = own.withColumn("u", all_of("parts")).select(
        *keep, F.col("step").alias("s1"), F.least("t", "u").alias("t1"), F.col("step").alias("s2"), F.greatest("t", "u").alias("t2"), (F.col("t") <= F.col("u")).alias("first"))
    large = own.where(F.col("members") > TILE)
    above = parts.select("block", (F.col("step") - 1).alias("step"), F.col("parts").alias("others"))
    below = parts.select("block", (F.col("step") + 1).alias("step"), F.col("parts").alias("others"))
    up = large.join(above, ["block", "step"]).withColumn("u", all_of("others")).select(
        *keep, F.col("step").alias("s1"), F.col("t").alias("t1"), (F.col("step") + 1).alias("s2"), F.col("u").alias("t2"), F.lit(True).alias("first"))
    down = large.join(below, ["block", "step"]).withColumn("u", all_of("others")).select(
        *keep, (F.col("step") - 1).alias("s1"), F.col("u").alias("t1"), F.col("step").alias("s2"), F.col("t").alias("t2"), F.lit(False).alias("first"))
    unit = F.struct("s1", "t1", "s2", "t2", "first")
    return same.union(up).union(down).groupBy(*keep).agg(F.collect_list(unit).alias("units"))  # about three for each tile of a size step


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Symmetric matrix: which of the sorted sets have a Jaccard similarity of ``threshold`` or more; false on the diagonal."""
    count, sizes = len(sets), np.array([len(s) for s in sets])
    if count == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        shared = np.array([[0, common], [common, 0]])
    else:
        owners = np.repeat(np.arange(count), sizes)
        values, places, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        used = np.cumsum(uses > 1) - 1  # elements of one set alone are in no intersection
        several = (uses > 1)[places]
        owners, places = owners[several], used[places[several]]
        order = np.argsort(places, kind="stable")
        owners, places = owners[order], places[order]
        shared = np.zeros((count, count), np.float32)
        width = max(1, min(4096, (1 << 24) // count))
        for start in range(0, int(places[-1]) + 1 if len(places) else 0, width):
            a, b = np.searchsorted(places, [start, start + width])
            held = np.zeros((count, width), np.float32)
            held[owners[a:b], places[a:b] - start] = 1
            shared += held @ held.T
    joined = sizes[:, None] + sizes[None, :] - shared
    linked = shared >= threshold * joined - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _verified(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["block", "s1", "t1", "s2", "t2"]):
            once = list({pair: i for i, pair in enumerate(zip(group.column("rep").to_pylist(), group.column("grams").to_pylist()))}.values())
            if len(once) < 2:
                continue
            group = group.take(once)  # a repeated row counts once
            ids, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in group.column("grams").to_pylist()]
            linked = similar(sets, threshold)
            linked &= ids[:, None] != ids[None, :]
            counted = linked
            one = tuple(group.column(c)[0].as_py() for c in ("s1", "t1", "s2", "t2"))
            if one[:2] != one[2:]:  # links inside a tile are counted where it is compared with itself
                first = group.column("first").to_numpy(zero_copy_only=False)
                counted = linked & (first[:, None] != first[None, :])
            links = counted.astype(np.int64) @ copies
            roots = ids[_rooted(linked)]
            some = (links > 0) | (roots != ids)
            if some.any():
                yield pa.record_batch([pa.array(ids[some]), pa.array(links[some]), pa.array(roots[some])], names=["rep", "links", "root"])

    return verify


_SETS = "block bigint, s1 bigint, t1 bigint, s2 bigint, t2 bigint, rep bigint, copies bigint, first boolean, grams binary"


def _gram_sets(words: int):
    """A text's n-gram set, once for each pair of tiles that it is compared in."""
    names = [x.split()[0] for x in _SETS.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.bool_(), pa.binary()]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            rows = []
            for row in batch.to_pylist():
                grams = np.unique(shingles(word_hashes(row["text"]), words)).tobytes()
                rows += [(row["block"], u["s1"], u["t1"], u["s2"], u["t2"], row["rep"], row["copies"], u["first"], grams) for u in row["units"]]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return sets


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, copy_of.

    Two documents are linked if the Jaccard similarity of their sets of ``words``-word n-grams (lower case, of letters, digits and underscores) is
    ``threshold`` or more. ``n_links`` counts the other documents that one is linked to, copies included; ``class_id`` is the smallest id that links
    lead to; ``copy_of`` the smallest id with an equal set. A text of fewer words is one n-gram; one without words, null or empty, has no links.
    A pair at the threshold is found with probability ``recall``, more similar ones more likely; each link found is verified on the full sets.
    Repeated rows are one document; an id with several texts has the links of all of them. Rows without an id are left apart: null class, their links not counted.
    """
    bands = bands_for(threshold, recall)
    rows = texts(docs)
    source = rows.where("doc_id IS NOT NULL")
    features = stored(source.mapInArrow(_features(words, bands, ROWS), _FEATURES), "features")
    documents = features.where("size > 0").select("doc_id", "k1", "k2", "size").distinct()
    classes = documents.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"))
    classes = stored(classes, "classes")
    firsts = features.where("size > 0").select(F.col("doc_id").alias("rep"), "k1", "k2", "bands", "sketch").dropDuplicates(["rep", "k1", "k2"])
    represented = firsts.join(classes, ["rep", "k1", "k2"], "left_semi")

    stars = candidate_stars(represented, threshold)
    roots = stored(components(stars, "blocks").select(F.col("node").alias("rep"), F.col("root").alias("block")), "roots")
    blocked = roots.union(roots.select(F.col("block").alias("rep"), "block").distinct())
    members = classes.groupBy("rep").agg(F.max("size").alias("size"), F.sum("copies").alias("copies")).join(blocked, "rep")

    sets = source.join(_tiled(members, threshold), F.col("doc_id") == F.col("rep")).drop("doc_id").mapInArrow(_gram_sets(words), _SETS)
    compared = sets.repartition("block", "s1", "t1", "s2", "t2").sortWithinPartitions("block", "s1", "t1", "s2", "t2", "rep")
    verified = stored(compared.mapInArrow(_verified(threshold), "rep bigint, links bigint, root bigint"), "verified")

    grouped = components(verified.select(F.col("rep").alias("a"), F.col("root").alias("b")), "links").withColumnRenamed("node", "rep")
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(links, "rep", "left").join(grouped, "rep", "left").select(
        "k1", "k2", "rep", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = documents.select("doc_id", "k1", "k2").join(known, ["k1", "k2"]).groupBy("doc_id").agg(
        F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"), F.min("rep").alias("copy_of"))
    empty = features.where("size = 0").select("doc_id").distinct().join(found.select("doc_id"), "doc_id", "left_anti")
    alone = empty.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("doc_id").alias("copy_of"))
    null = F.lit(None).cast("bigint")
    nameless = rows.where("doc_id IS NULL").select("doc_id", null.alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), null.alias("copy_of"))
    return found.unionByName(alone).unionByName(nameless)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class, that of the smallest id. All columns stay; rows without an id stay too."""
    own = "_".join(["key", *docs.columns])
    dropped = join(docs, **options).where("class_id <> doc_id").select(F.col("doc_id").alias(own))
    return docs.join(dropped, docs["doc_id"].cast("bigint") == F.col(own), "left_anti")
