import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nosoflow.llm import negatives

SCHEMA = "vec_id bigint, label int, embedding array<float>, v string, leaf int, tile int, score double"


def table(spark, rows):
    """Rows with columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, label, v, "x", 3, 4, 0.5) for i, label, v in rows], SCHEMA)


def whole(rows):
    """vec_id to label and components; of equal ids the least label, then vector."""
    out = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        one = (label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        out[i] = min(out.get(i, one), one)
    return out


def brute(rows, step=100, shift=True, positives=5, count=5):
    known = whole(rows)
    if shift:
        known = {i: ((label + 1) % 10 if i % 7 == 0 else label, v) for i, (label, v) in known.items()}
    out = set()
    for a in (i for i in known if i % step == 0):
        label, v = known[a]
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in known.items()}
        same = sorted((i for i in known if i != a and known[i][0] == label), key=lambda i: (-score[i], i))[:positives]
        for p in same:
            fit = [i for i in known if known[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            for rank, i in enumerate(sorted(fit, key=lambda i: (-score[i], i))[:count], 1):
                out.add((a, p, rank, i, score[p], score[i]))
    return out


def random_rows(seed, count, width=6, copies=0):
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(10), [rnd.gauss(0.2, 0.5) for _ in range(width)]) for i in range(count)]
    return rows + [(count + i, rnd.randrange(3), rows[5][2]) for i in range(copies)]


def got(df):
    return sorted(map(tuple, df.collect()))


def test_equals_all_products(spark):
    rows = random_rows(1, 700)
    assert got(negatives.hard_negatives(table(spark, rows))) == sorted(brute(rows))


def test_small_leaves_tiles_and_blocks_with_many_copies(spark, monkeypatch):
    for name, value in (("FIT_ROWS", 200), ("LEAF", 10), ("FAN_OUT", 3), ("TILE", 7), ("BLOCK", 2), ("STEP", 5)):
        monkeypatch.setattr(negatives, name, value)
    rows = random_rows(2, 500, copies=250)
    found = negatives.mine(negatives.whole_numbers(table(spark, rows)), F.col("vec_id") % 50 == 0)
    assert got(found) == sorted(brute(rows, 50, shift=False))


def test_a_sample_that_holds_few_rows_loses_none(spark):
    rows = random_rows(3, 400, width=3)
    kept = negatives.whole_numbers(table(spark, rows))
    tree = negatives.index(kept, fit_rows=20)
    assert 0 < len(tree.ids) < 60 and tree.rows.count() == 400
    assert negatives.index(kept.where("vec_id < 0")) is None


def test_ranges_rule_out_leaves_but_never_one_with_a_row_in_the_ring():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 400, (12, 5))
    points = np.floor(centres[rng.integers(0, 12, 900)] + rng.normal(0, 10, (900, 5)))
    radius2 = float((points**2).sum(axis=1).max())
    lifted = negatives.lifted(points, radius2)
    assert np.allclose((lifted**2).sum(axis=1), radius2)
    root, nodes, leaves = negatives.grown(lifted[:200], 4, 10)
    for node in nodes:
        node.least, node.most = np.full((len(node.points),) * 2, np.inf), np.full((len(node.points),) * 2, -np.inf)

    def seen(node, away, nearest):
        for j in set(nearest.tolist()):
            node.least[:, j] = np.minimum(node.least[:, j], away[nearest == j].min(axis=0))
            node.most[:, j] = np.maximum(node.most[:, j], away[nearest == j].max(axis=0))

    leaf = negatives.placed(root, lifted, seen)
    anchors = np.concatenate((points[:50], np.zeros((50, 1))), axis=1)
    scores = points[:50] @ points.T
    low, high = np.quantile(scores, 0.97, axis=1), np.quantile(scores, 0.99, axis=1)
    lengths = (points[:50]**2).sum(axis=1) + radius2
    inner, outer = np.sqrt(np.maximum(lengths - 2 * high, 0)), np.sqrt(np.maximum(lengths - 2 * low, 0))
    reached = [set() for _ in range(50)]
    for number, some in negatives.reached(root, anchors, inner, outer, 1e-6 * radius2**0.5):
        for a in some.tolist():
            reached[a].add(number)
    for a in range(50):
        inside = (scores[a] >= low[a]) & (scores[a] <= high[a])
        assert set(leaf[inside].tolist()) <= reached[a]
    assert np.mean([len(r) for r in reached]) < 0.7 * leaves


@pytest.mark.parametrize("value", [0.0, -0.5])
def test_ties_and_windows_of_scores_that_are_not_positive(spark, value):
    rows = [(i, i % 3, [value, 1.0 if i else -1.0]) for i in range(40)] + [(100 + i, 1, [0.0, 0.0]) for i in range(12)]
    assert got(negatives.hard_negatives(table(spark, rows))) == sorted(brute(rows))


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(5, 210, width=4)
    rows += [(None, 1, [1.0] * 4), (400, None, [1.0] * 4), (401, 2, None), (402, 2, [1.0, None, 1.0, 1.0]), (403, 2, [nan] * 4), (404, 2, [inf, 0.0, 0.0, 0.0])]
    rows += rows[:30] + [(7, 0, [0.1] * 4), (8, 9, [0.3] * 4), (-100, 3, [0.4] * 4), (9_000_000_000, 4, [0.2, 0.1, 0.0, 0.5])]
    assert got(negatives.hard_negatives(table(spark, rows))) == sorted(brute(rows))
    none = table(spark, [(1, 1, [0.5])]).where("vec_id < 0")
    assert negatives.hard_negatives(none).collect() == []
    assert negatives.hard_negatives(none).columns == negatives.hard_negatives(table(spark, rows)).columns


def test_unequal_lengths_and_an_empty_vector(spark):
    rows = [(i, i % 2, [0.1 * i] * (i % 4)) for i in range(0, 120, 2)] + [(i, i % 2, [0.2] * 3) for i in range(1, 30, 2)]
    assert got(negatives.hard_negatives(table(spark, rows))) == sorted(brute(rows))


def test_products_beyond_the_exact_range_of_doubles():
    a = np.array([[2.0**26, 3.0, -(2.0**26)]])
    b = np.array([[2.0**26, 1.0, 2.0**26 - 1]])
    assert negatives.products(a, b).tolist() == [[2**52 + 3 - (2**26) * (2**26 - 1)]]


def test_best_keeps_the_first_rows_of_each_owner():
    rnd = random.Random(6)
    best, seen = negatives.Best(np.full(4, -np.inf), 3), {}
    for _ in range(30):
        part = [(rnd.randrange(4), rnd.randrange(6), rnd.randrange(50)) for _ in range(rnd.randrange(6))]
        part = [(o, s, i) for o, s, i in part if seen.setdefault((o, i), s) == s]
        best.add(*(np.array(c, np.int64) for c in zip(*part)) if part else (np.zeros(0, np.int64),) * 3)
    for owner in range(4):
        want = sorted((-s, i) for (o, i), s in seen.items() if o == owner)[:3]
        mine = best.owner == owner
        assert list(zip((-best.score[mine]).tolist(), best.id[mine].tolist())) == want
