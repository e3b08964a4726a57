"""Hard negatives of anchors by a GNAT-style multiway hyperplane tree.

An inner product is no metric, so rows are lifted onto a sphere: a further component, the root of what their squared length lacks to the largest one, makes
all lengths equal. From an anchor, whose further component is 0, a row's distance then falls as its inner product grows, and a window of products is an
annulus around the anchor.

1. The tree: split points are chosen from a bounded sample, every row goes to the leaf below its nearest split points, and each split point stores the
   least and the greatest distance to the rows of each sibling's subtree, over all rows.
2. A search: an anchor goes to the leaves whose subtrees no split point rules out, as the range of its distances to the subtree has to meet the ring that the
   triangle inequality leaves of the annulus. Leaves are exact: anchors and rows of a leaf meet in tiles, and all their products are formed.
3. Searches are two: the first products of the same label, then, for each of these, the first of other labels in the window below it. Exact
   products with the sample give either a bound to start from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nosoflow.llm.common import stored

#: Rows that split points and starting bounds are taken from, at most (expected number; drawn by a hash of the id).
FIT_ROWS = 8192
#: Split points of a node, and sample rows of a leaf.
FAN_OUT, LEAF = 8, 256
#: Rows of a leaf, and anchors, that meet in one task. Rows are read in steps, anchors are held.
TILE, BLOCK, STEP = 32_768, 8_192, 512
#: Components are held between these limits, which no sum of products of up to 2,048 of them exceeds 63 bits at.
LIMIT = 1 << 26
#: Share of the sphere's radius by which distances may be off.
_SLACK = 1e-6


@dataclass
class Node:
    """Split points on the sphere; for each of their subtrees a node or, at the bottom, the number of a leaf; ranges[i][j]: distances of point i to subtree j."""

    number: int
    points: np.ndarray
    below: list["Node | int"] = field(default_factory=list)
    least: np.ndarray | None = None
    most: np.ndarray | None = None


def lifted(vectors: np.ndarray, radius2: float) -> np.ndarray:
    """With the further component that puts each vector onto the sphere."""
    lacking = np.sqrt(np.maximum(radius2 - (vectors * vectors).sum(axis=1), 0.0))
    return np.concatenate((vectors, lacking[:, None]), axis=1)


def distances(points: np.ndarray, splits: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(axis=1)[:, None] + (splits * splits).sum(axis=1)[None, :] - 2 * points @ splits.T
    return np.sqrt(np.maximum(squares, 0.0))


def grown(sample: np.ndarray, fan_out: int | None = None, leaf: int | None = None) -> tuple[Node | int, list[Node], int]:
    """Tree over the points of a sample, its nodes, and the number of leaves. Split points are far from each other; copies of a point stay in one leaf."""
    fan_out, leaf = fan_out or FAN_OUT, leaf or LEAF
    nodes: list[Node] = []
    leaves = 0

    def grow(rows: np.ndarray) -> Node | int:
        nonlocal leaves
        chosen, gap = [rows[0]] if len(rows) else [], None
        while len(rows) > leaf and len(chosen) < fan_out:
            from_last = distances(sample[rows], sample[chosen[-1:]])[:, 0]
            gap = from_last if gap is None else np.minimum(gap, from_last)
            if gap.max() <= 1e-3:
                break
            chosen.append(rows[int(gap.argmax())])
        if len(chosen) < 2:
            leaves += 1
            return leaves - 1
        node = Node(len(nodes), sample[chosen])
        nodes.append(node)
        nearest = distances(sample[rows], node.points).argmin(axis=1)
        node.below = [grow(rows[nearest == j]) for j in range(len(chosen))]
        return node

    root = grow(np.arange(len(sample)))
    return root, nodes, leaves


def placed(root: Node | int, points: np.ndarray, seen: Callable[[Node, np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
    """Leaf of each point. ``seen`` is told the distances to a node's split points, and to which of them the points went."""
    out = np.zeros(len(points), np.int32)

    def place(node: Node | int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, int):
            out[rows] = node
            return
        away = distances(points[rows], node.points)
        nearest = away.argmin(axis=1)
        if seen:
            seen(node, away, nearest)
        for j, child in enumerate(node.below):
            place(child, rows[nearest == j])

    place(root, np.arange(len(points)))
    return out


def reached(root: Node | int, anchors: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: float) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves that may hold rows in the annulus from ``inner`` to ``outer`` around each anchor, and the anchors of each leaf."""

    def reach(node: Node | int, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if isinstance(node, int):
            yield node, rows
            return
        away = distances(anchors[rows], node.points)
        for j, child in enumerate(node.below):
            least, most = node.least[:, j][None, :], node.most[:, j][None, :]
            nearer = np.maximum(least - away, away - most).max(axis=1)
            farther = (away + most).min(axis=1)
            some = rows[(nearer <= outer[rows] + slack) & (farther >= inner[rows] - slack)]
            if len(some):
                yield from reach(child, some)

    if len(anchors):
        yield from reach(root, np.arange(len(anchors)))


@dataclass
class Index:
    """Rows (leaf, vec_id, label, v) as a stored table, the tree over them, and the sample."""

    rows: DataFrame
    root: Node | int
    radius2: float
    width: int
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def whole_numbers(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """vec_id, label, v: floor(256 * x) of each component x.

    Rows take no part that lack an id, a label or a vector, or have a null or non-finite component. Of rows with an equal id, the one of the smallest
    label, then vector stays, so repeated rows count once. Components beyond ``LIMIT`` are held there.
    """
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(256 * c, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    rows = vectors.select(vectors[vec_id].cast("bigint").alias("vec_id"), vectors[label].cast("bigint").alias("label"), vectors[vector].alias(vector))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL").where(F.col(vector).isNotNull() & ~odd)
    one = F.min(F.struct("label", "v")).alias("r")
    return rows.select("vec_id", "label", whole.alias("v")).groupBy("vec_id").agg(one).select("vec_id", "r.label", "r.v")


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix; a shorter vector is followed by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    for row, (start, length) in enumerate(zip(np.cumsum(lengths) - lengths, lengths)):
        out[row, :length] = values[start:start + length]
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in floating point while they stay below 2^53."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)))
    if np.abs(left).max() * np.abs(right).max() * left.shape[1] < 2**53:
        return left @ right.T
    return left.astype(np.int64) @ right.astype(np.int64).T


def index(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Index | None:
    """The tree over ``rows`` (vec_id, label, v). It is fitted on about ``fit_rows`` of them and holds every one; None without rows."""
    spark = rows.sparkSession
    rows = stored(rows, "whole")
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("radius2"), F.max(F.size("v")).alias("width")).first()
    if not size.n:
        return None
    radius2, width = float(size.radius2), int(size.width)
    drawn = F.pmod(F.xxhash64(F.lit(12), "vec_id"), F.lit(1 << 30)) < int(min(1.0, fit_rows / size.n) * (1 << 30))
    sample = rows.where(drawn).orderBy("vec_id").toArrow()
    vectors = _matrix(sample.column("v"), width)
    root, nodes, leaves = grown(lifted(vectors, radius2))
    tree = spark.sparkContext.broadcast(root)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = placed(tree.value, lifted(_matrix(batch.column("v"), width), radius2))
            yield pa.record_batch([pa.array(leaf), *batch.columns], names=["leaf", "vec_id", "label", "v"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], list[float]] = {}

        def seen(node: Node, away: np.ndarray, nearest: np.ndarray) -> None:
            for j in np.unique(nearest).tolist():
                part = away[nearest == j]
                for i, (least, most) in enumerate(zip(part.min(axis=0).tolist(), part.max(axis=0).tolist())):
                    known = found.setdefault((node.number, i, j), [least, most])
                    known[:] = min(known[0], least), max(known[1], most)

        for batch in batches:
            placed(tree.value, lifted(_matrix(batch.column("v"), width), radius2), seen)
        columns = list(zip(*((*key, *span) for key, span in found.items()))) or [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "i", "j", "least", "most"])

    kept = stored(rows.mapInArrow(place, "leaf int, vec_id bigint, label bigint, v array<int>"), "leaves")
    spans = kept.select("vec_id", "label", "v").mapInArrow(measure, "node int, i int, j int, least double, most double")
    for node in nodes:
        node.least = np.full((len(node.points),) * 2, np.inf)  # no row below: every ring misses it
        node.most = np.full((len(node.points),) * 2, -np.inf)
    for r in spans.groupBy("node", "i", "j").agg(F.min("least").alias("least"), F.max("most").alias("most")).toLocalIterator():
        nodes[r.node].least[r.i, r.j], nodes[r.node].most[r.i, r.j] = r.least, r.most
    return Index(kept, root, radius2, width, sample.column("vec_id").to_numpy(), sample.column("label").to_numpy(), vectors)


_INF = float("inf")


class Best:
    """The first ``count`` rows of each owner: higher scores first, ties by smaller id. An id counts once for an owner."""

    def __init__(self, floors: np.ndarray, count: int):
        self.floors, self.count = floors.copy(), count
        self.owner, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(owner):
            return
        owner, score, ids = (np.concatenate(x) for x in ((self.owner, owner), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, owner))
        owner, score, ids = owner[order], score[order], ids[order]
        fresh = np.ones(len(owner), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
        owner, score, ids = owner[fresh], score[fresh], ids[fresh]
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
        held = rank < self.count
        self.owner, self.score, self.id = owner[held], score[held], ids[held]
        last = rank == self.count - 1
        self.floors[owner[last]] = np.maximum(self.floors[owner[last]], score[last])


def _same_label(vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, row_labels: np.ndarray, best: Best) -> None:
    scores = products(vectors, rows)
    fit = (labels[:, None] == row_labels[None, :]) & (ids[:, None] != row_ids[None, :]) & (scores >= best.floors[:, None])
    a, b = np.nonzero(fit)
    best.add(a, scores[a, b], row_ids[b])


def _other_label(vectors: np.ndarray, labels: np.ndarray, tops: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, row_labels: np.ndarray, best: Best) -> None:
    """Owners are anchors times windows; ``tops`` are the windows' upper ends, minus infinity where an anchor has fewer windows."""
    scores = products(vectors, rows)
    differs = labels[:, None] != row_labels[None, :]
    width = tops.shape[1]
    for k in range(width):
        floors = best.floors[k::width]
        a, b = np.nonzero(differs & (scores <= tops[:, k][:, None]) & (scores >= floors[:, None]))
        best.add(a * width + k, scores[a, b], row_ids[b])


def _floors(tops: np.ndarray, low: int, high: int) -> np.ndarray:
    """Least whole score of each window [low/high * top, top]; infinite for an empty one, which a negative top has."""
    known = np.isfinite(tops)
    whole = np.where(known, tops, 0).astype(object)
    least = np.array([-((-low * int(t)) // high) for t in whole.ravel()], dtype=np.float64).reshape(tops.shape)
    return np.where(known & (least <= np.where(known, tops, 0)), least, _INF)


def _tops(column: pa.Array, windows: int) -> np.ndarray:
    out = np.full((len(column), windows), -_INF)
    for row, values in enumerate(column.to_pylist()):
        out[row, :len(values or [])] = values or []
    return out


_ANCHOR = "vec_id bigint, label bigint, v array<int>, tops array<bigint>"
_ROUTED = "leaf int, vec_id bigint, label bigint, v array<int>, tops array<bigint>, floors array<double>"


def _routed(tree: Index, anchors: DataFrame, count: int, windows: int, low: int, high: int) -> DataFrame:
    """Each anchor once for each leaf that its annulus meets, with the bounds that the sample's exact scores give."""
    shared = anchors.sparkSession.sparkContext.broadcast((tree.root, tree.ids, tree.labels, tree.vectors))
    width, radius2 = tree.width, tree.radius2
    slack = _SLACK * (radius2**0.5 + 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, ids, labels, sample = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                batch = whole.slice(start, STEP)
                vectors, own = _matrix(batch.column("v"), width), batch.column("label").to_numpy()
                if windows:
                    tops = _tops(batch.column("tops"), windows)
                    best = Best(_floors(tops, low, high).ravel(), count)
                    _other_label(vectors, own, tops, sample, ids, labels, best)
                    floors = best.floors.reshape(tops.shape)
                    least, most = floors.min(axis=1), np.where(floors < _INF, tops, -_INF).max(axis=1)
                else:
                    best = Best(np.full(len(own), -_INF), count)
                    _same_label(vectors, batch.column("vec_id").to_numpy(), own, sample, ids, labels, best)
                    floors = best.floors[:, None]
                    least, most = floors[:, 0], np.full(len(own), _INF)
                lengths = (vectors * vectors).sum(axis=1) + radius2
                outer = np.sqrt(np.maximum(lengths - 2 * least, 0.0))
                inner = np.sqrt(np.maximum(lengths - 2 * most, 0.0))
                outer[least == _INF] = -_INF
                points = np.concatenate((vectors, np.zeros((len(own), 1))), axis=1)
                listed = pa.array(floors.tolist(), pa.list_(pa.float64()))
                for leaf, some in reached(root, points, inner, outer, slack):
                    some = some[outer[some] > -_INF]
                    if len(some):
                        part = batch.take(pa.array(some))
                        yield pa.record_batch([pa.array(np.full(len(some), leaf, np.int32)), *part.columns, listed.take(pa.array(some))], names=[x.split()[0] for x in _ROUTED.split(", ")])

    return anchors.mapInArrow(route, _ROUTED)


_MET = "leaf int, tile bigint, block bigint, row boolean, vec_id bigint, label bigint, v array<int>, tops array<bigint>, floors array<double>"
_FOUND = "anchor_id bigint, slot int, vec_id bigint, score bigint"


def _exact(width: int, count: int, windows: int):
    """Exact search of a tile: its anchors, which come first, are held, its rows pass in steps."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, anchors, best, waiting = None, None, None, []

        def settle() -> None:
            nonlocal anchors, best, waiting
            if anchors is None and waiting:
                part = pa.Table.from_batches(waiting)
                vectors, ids, labels = _matrix(part.column("v"), width), part.column("vec_id").to_numpy(), part.column("label").to_numpy()
                floors = np.array(part.column("floors").to_pylist(), float)
                tops = _tops(part.column("tops").combine_chunks(), windows) if windows else None
                anchors, best, waiting = (vectors, ids, labels, tops), Best(floors.ravel(), count), []

        def result() -> Iterator[pa.RecordBatch]:
            if anchors is not None and len(best.owner):
                per = max(windows, 1)
                columns = (anchors[1][best.owner // per], (best.owner % per).astype(np.int32), best.id, best.score.astype(np.int64))
                yield pa.record_batch([pa.array(c) for c in columns], names=["anchor_id", "slot", "vec_id", "score"])

        for whole in batches:
            keys = np.stack([whole.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("leaf", "tile", "block", "row")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                key, is_row = tuple(keys[start, :3].tolist()), bool(keys[start, 3])
                if key != owner:
                    yield from result()
                    owner, anchors, best, waiting = key, None, None, []
                if not is_row:
                    waiting.append(whole.slice(start, end - start))
                    continue
                settle()
                if anchors is None:
                    continue
                for at in range(start, end, STEP):
                    part = whole.slice(at, min(STEP, end - at))
                    rows, ids, labels = _matrix(part.column("v"), width), part.column("vec_id").to_numpy(), part.column("label").to_numpy()
                    if windows:
                        _other_label(anchors[0], anchors[2], anchors[3], rows, ids, labels, best)
                    else:
                        _same_label(anchors[0], anchors[1], anchors[2], rows, ids, labels, best)
        yield from result()

    return search


def first_rows(tree: Index, anchors: DataFrame, count: int, windows: int = 0, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, slot, vec_id, score, place: for each anchor (``vec_id, label, v, tops``) the first ``count`` rows.

    Without ``windows`` these are other rows of the same label; with them, for each of the up to ``windows`` scores in ``tops``, rows of other labels whose
    score is in the window below it. A leaf of many rows and many anchors is cut into tiles and blocks, dealt by a hash of the id.
    """
    routed = stored(_routed(tree, anchors, count, windows, low, high), "routed")
    zero = F.lit(0).cast("bigint")
    all_of = lambda c: F.explode(F.sequence(zero, F.col(c) - 1))
    parts = tree.rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles")).join(
        routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "leaf")  # a row for each leaf of the bounded tree
    parts = F.broadcast(stored(parts, "parts"))
    dealt: Callable[[str], Column] = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c))
    held = routed.join(parts, "leaf").withColumn("block", dealt("blocks")).withColumn("tile", all_of("tiles"))
    held = held.select("leaf", "tile", "block", F.lit(False).alias("row"), "vec_id", "label", "v", "tops", "floors")
    passing = tree.rows.join(parts, "leaf").withColumn("tile", dealt("tiles")).withColumn("block", all_of("blocks"))
    none = [F.lit(None).cast("array<bigint>").alias("tops"), F.lit(None).cast("array<double>").alias("floors")]
    passing = passing.select("leaf", "tile", "block", F.lit(True).alias("row"), "vec_id", "label", "v", *none)
    key = ["leaf", "tile", "block"]
    met = held.union(passing).repartition(*key).sortWithinPartitions(*key, "row")
    found = met.mapInArrow(_exact(tree.width, count, windows), _FOUND)
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (vec_id, label, v as ``whole_numbers`` gives them).

    Anchors are the rows that meet the condition ``anchor``. An anchor's positives are its first ``positives`` other rows of the same label by inner product
    (ties: smaller id), all if there are fewer. For each of them come the first ``negatives`` rows of other labels whose score is between
    ``low / high`` of the positive's score and that score, in whole numbers; a negative score has no such rows. An anchor without positives, or a positive without
    negatives, gives no row; no row of ``rows`` is left out of either search. Vectors of unequal length are continued by zeros; empty tables give no rows.
    """
    tree = index(rows)
    if tree is None:
        return rows.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    own = tree.rows.where(anchor).select("vec_id", "label", "v", F.lit(None).cast("array<bigint>").alias("tops"))
    same = stored(first_rows(tree, own, positives), "positives")
    tops = same.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("tops"))
    tops = own.drop("tops").join(tops.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select("vec_id", "label", "v", "tops")
    other = first_rows(tree, tops, negatives, positives, low, high)
    other = other.select("anchor_id", (F.col("slot") + 1).alias("place"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    same = same.select("anchor_id", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return same.join(other, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100, as ``mine`` gives them.

    Before, the label of a row whose id is divisible by 7 moves on by one, modulo 10.
    """
    rows = whole_numbers(embeddings)
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 100 == 0)
