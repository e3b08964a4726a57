"""Best-fit packing of documents into training sequences, where a bin holds no two pieces of one source or of one duplicate cluster.

Items are dealt to shards by a hash, so a hot source or cluster is spread evenly. A shard packs its items from the longest to the shortest: each goes
to the bin with the smallest sufficient residual whose bitmaps of sources and clusters don't meet the item's; the search goes on to the next
residual until a compatible bin is found, or a new one is opened.
"""

from __future__ import annotations

from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nosoflow.llm.common import stored

#: Tokens of a bin; with byte-level tokens a document has one for each UTF-8 byte and one for its end.
CAPACITY = 8192
#: Expected number of items that one task packs together.
SHARD_ITEMS = 4096
_EMPTY = 1  # this bit is in no bin's bitmap; where no bin is, all bits are set


class Bins:
    """Bins ordered by residual: a binary tree over 0..capacity, whose leaves hold the bins of one residual.

    A node keeps the intersection of the bitmaps of all bins below it. Where that meets an item's bitmap, every bin below conflicts and the
    search passes over them together. Bins of the same residual and bitmap are interchangeable and held as one heap.
    """

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.common = [-1] * (2 * self.width)
        self.leaves: dict[int, dict[int, list[int]]] = {}

    def _renew(self, residual: int) -> None:
        node, common = self.width + residual, -1
        for bitmap in self.leaves[residual]:
            common &= bitmap
        while node and self.common[node] != common:
            self.common[node] = common
            common &= self.common[node ^ 1]
            node >>= 1

    def put(self, residual: int, bitmap: int, number: int) -> None:
        heaps = self.leaves.setdefault(residual, {})
        heappush(heaps.setdefault(bitmap, []), number)
        if len(heaps[bitmap]) == 1:
            self._renew(residual)

    def take(self, needed: int, bitmap: int) -> tuple[int, int, int] | None:
        """Remove the tightest compatible bin; of equal residuals the one opened first. Returns its residual, bitmap and number."""
        residual = self._next(needed, bitmap)
        while residual is not None:
            heaps = self.leaves[residual]
            fitting = [(heap[0], held) for held, heap in heaps.items() if not held & bitmap]
            if fitting:
                number, held = min(fitting)
                heappop(heaps[held])
                if not heaps[held]:
                    del heaps[held]
                    self._renew(residual)
                return residual, held, number
            residual = self._next(residual + 1, bitmap)
        return None

    def _next(self, needed: int, bitmap: int) -> int | None:
        """Smallest residual from ``needed`` on whose bins don't all have one of the bits of ``bitmap`` in common."""
        node, bitmap = self.width + needed, bitmap | _EMPTY
        while needed < self.width:
            if self.common[node] & bitmap:
                while node & 1:
                    node >>= 1
                if not node:
                    return None
                node += 1
            elif node >= self.width:
                return node - self.width
            else:
                node *= 2
        return None


def pack(items: list[tuple[int, int | None, int | None]], capacity: int) -> tuple[list[tuple[int, int]], int]:
    """Bin number and offset of each item (length, source, cluster), in the order given, and the number of bins.

    Items of one source, or of one cluster, don't share a bin; None conflicts with none. Equal lengths are placed in the order given.
    """
    counts: dict[tuple, int] = {}
    for _, source, cluster in items:
        counts[0, source] = counts.get((0, source), 0) + 1
        counts[1, cluster] = counts.get((1, cluster), 0) + 1
    bits = {key: _EMPTY << n for n, key in enumerate((k for k, c in counts.items() if c > 1 and k[1] is not None), 1)}
    bins, opened, placed = Bins(capacity), 0, [(0, 0)] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        length, source, cluster = items[i]
        bitmap = bits.get((0, source), 0) | bits.get((1, cluster), 0)
        residual, held, number = bins.take(length, bitmap) or (capacity, 0, opened)
        opened += number == opened
        placed[i] = (number, capacity - residual)
        bins.put(residual - length, held | bitmap, number)
    return placed, opened


_PACKED = "doc_id bigint, piece bigint, start bigint, length bigint, bin_id bigint, bin_offset bigint"


def _pack_shard(capacity: int):
    names, kind = [x.split()[0] for x in _PACKED.split(", ")], pa.int64()

    def packed(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("length", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        ids, lengths, first = shard.column("doc_id").to_pylist(), shard.column("length").to_pylist(), shard.column("shard")[0].as_py() << 32
        rests = [i for i, n in enumerate(lengths) if n % capacity]
        sources, clusters = (shard.column(c).to_pylist() for c in ("source", "cluster"))
        placed, opened = pack([(lengths[i] % capacity, sources[i], clusters[i]) for i in rests], capacity)
        rows = [(ids[i], lengths[i] // capacity, lengths[i] // capacity * capacity, lengths[i] % capacity, first + number, at) for i, (number, at) in zip(rests, placed)]
        for doc_id, length in zip(ids, lengths):
            for piece in range(length // capacity):  # a full bin of its own
                rows.append((doc_id, piece, piece * capacity, capacity, first + opened, 0))
                opened += 1
        return pa.table([pa.array(c, kind) for c in (zip(*rows) if rows else [[]] * len(names))], names=names)

    return packed


def byte_tokens(text: Column) -> Column:
    """UTF-8 bytes and an end token; a null text has the end token alone."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def pack_documents(docs: DataFrame, length: Column | None = None, cluster: Column | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, bin_id, bin_offset.

    ``length`` counts a document's tokens (by default ``byte_tokens``) and ``cluster`` names its duplicates (by default a hash of its text). A
    document longer than ``capacity`` is cut; its full pieces are bins of their own and the rest is packed. No bin holds two
    pieces of one source or cluster; a null source conflicts with none. Null and empty texts have one token and are packed too; rows of
    no token give no row. Repeated rows are packed as often as they occur. The result doesn't depend on the order of the input. ``bin_id`` is the
    shard's number times 2^32 plus the bin's. Only narrow rows are shuffled.
    """
    length = byte_tokens(docs["text"]) if length is None else length
    cluster = F.xxhash64(F.coalesce(docs["text"], F.lit(""))) if cluster is None else cluster
    items = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), length.cast("bigint").alias("length"), F.xxhash64(docs["source"]).alias("hashed"),
        docs["source"].isNull().alias("nowhere"), cluster.cast("bigint").alias("cluster"))
    items = items.withColumn("source", F.when(~F.col("nowhere"), F.col("hashed"))).drop("hashed", "nowhere")
    items = stored(items, "items").where("length > 0")  # after the write, so that a length that takes long is not calculated for the filter, too
    shards = max(1, -(-items.count() // SHARD_ITEMS))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "length", "cluster"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_pack_shard(capacity), _PACKED)
