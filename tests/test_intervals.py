import random

import pytest
from pyspark.sql import functions as F

from nosoflow.operators import hierarchy, intervals, scaling


def brute(start, known, children):
    seen, todo = set(), [start]
    while todo:
        x = todo.pop()
        if x in known and x not in seen:
            seen.add(x)
            todo += children.get(x, [])
    return seen


def frames(spark, known, links, kind="bigint"):
    nodes = spark.createDataFrame([(i, c) for i, c in known.items()], f"id {kind}, code string")
    return nodes, spark.createDataFrame(links, f"parent {kind}, child {kind}")


def graph(seed):
    """Trees with some nodes of several parents, loops of several lengths, nodes behind loops, edges to unknown nodes and to the node itself."""
    rnd = random.Random(seed)
    count = rnd.randrange(20, 60)
    known = {i: rnd.choice([f"X{i}", f"C{i}", None]) for i in range(count)}
    links = [(rnd.randrange(max(1, i - rnd.choice([3, 20]))), i) for i in range(1, count) if rnd.random() < 0.9]
    links += [(rnd.randrange(count), rnd.randrange(count)) for _ in range(rnd.choice([0, 2, 8, 25]))]
    links += [(count, 1), (1, count + 5), (3, 3)] + links[:4]
    return known, links


@pytest.mark.parametrize("seed", range(3))
def test_ranges_equal_walks_on_graphs_with_loops(spark, seed):
    known, links = graph(seed)
    children = {}
    for p, c in links:
        children.setdefault(p, []).append(c)
    nodes, edges = frames(spark, known, links)
    tree = intervals.label(nodes, edges)
    assert sorted(r.place for r in tree.ranked.collect()) == list(range(1, len(known) + 1))
    starts = spark.createDataFrame([(i,) for i in [*known, *known, 999]], "start_id bigint")
    want = {i: brute(i, known, children) for i in known}
    ranges = intervals.ranges_of(starts, tree)
    rows = intervals.members(ranges, ["start_id"], tree).collect()
    assert sorted((r.start_id, r.id, r.code) for r in rows if r.code) == sorted((s, i, known[i]) for s, w in want.items() for i in w if known[i])
    assert sorted((r.start_id, r.id) for r in rows) == sorted((s, i) for s, w in want.items() for i in w)
    counts = {r.start_id: r.n for r in intervals.sizes(ranges, ["start_id"], tree).collect()}
    assert counts == {s: sum(known[i] is not None for i in w) for s, w in want.items()}
    rnd = random.Random(seed)
    axes = [(rnd.randrange(4), rnd.choice("ab"), "NotAllowed", rnd.randrange(len(known) + 3)) for _ in range(30)]
    frame = spark.createDataFrame(axes, "root bigint, axe string, allow_multiple string, start_id bigint")
    sized = {(r.root, r.axe): r.n for r in hierarchy.tree_axis_sizes(frame, nodes, edges).collect()}
    union = {(r, a): {i for x, y, _, s in axes if (x, y) == (r, a) for i in want.get(s, ())} for r, a, _, _ in axes}
    assert sized == {k: sum(known[i] is not None for i in w) for k, w in union.items()}


def test_a_loop_alone_and_two_loops_that_meet(spark):
    nodes, edges = frames(spark, {i: f"X{i}" for i in range(1, 8)}, [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 5), (6, 1), (4, 7)])
    tree = intervals.label(nodes, edges)
    starts = nodes.select(F.col("id").alias("start_id"))
    found = {}
    for r in intervals.members(intervals.ranges_of(starts, tree), ["start_id"], tree).collect():
        found.setdefault(r.start_id, []).append(r.id)
    assert {s: sorted(v) for s, v in found.items()} == {
        1: [1, 2, 3, 4, 7], 2: [1, 2, 3, 4, 7], 3: [1, 2, 3, 4, 7], 4: [4, 7], 5: [1, 2, 3, 4, 5, 6, 7], 6: [1, 2, 3, 4, 5, 6, 7], 7: [7]}


def test_long_ranges_are_taken_apart_in_chunks_and_a_chain_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(intervals, "CHUNK", 7)
    rounds = []
    names = [f"n{i:03d}" for i in range(120)]
    nodes, edges = frames(spark, {n: n for n in names}, list(zip(names, names[1:])), "string")
    tree = intervals.label(nodes, edges, lambda df, name: rounds.append(name) or scaling.cut_lineage(df))
    assert len(rounds) < 16
    starts = spark.createDataFrame([("n000",), ("n100",)], "start_id string")
    rows = intervals.members(intervals.ranges_of(starts, tree), ["start_id"], tree)
    assert sorted((r.start_id, r.id) for r in rows.collect()) == [("n000", n) for n in names] + [("n100", n) for n in names[100:]]


def test_a_second_start_goes_on_at_the_last_finished_round(spark, tmp_path):
    known, links = graph(1)
    nodes, edges = frames(spark, known, links + [(7, 2), (2, 7)])
    starts = nodes.select(F.col("id").alias("start_id"))
    whole = scaling.Rounds(spark, f"file://{tmp_path}/whole")
    tree = intervals.label(nodes, edges, whole)
    want = sorted(map(tuple, intervals.members(intervals.ranges_of(starts, tree), ["start_id"], tree).na.fill("").collect()))
    assert len(whole.computed) > 6

    class Lost(Exception):
        pass

    done: list[str] = []
    for finished in range(0, len(whole.computed), 2):  # killed after two more rounds each time
        rounds = scaling.Rounds(spark, f"file://{tmp_path}/killed")

        def keep(df, name, rounds=rounds):
            if len(rounds.computed) == 2:
                raise Lost
            return rounds(df, name)

        try:
            tree = intervals.label(nodes, edges, keep)
        except Lost:
            pass
        done += rounds.computed
    last = scaling.Rounds(spark, f"file://{tmp_path}/killed")
    tree = intervals.label(nodes, edges, last)
    assert done == whole.computed and last.computed == []  # no round was made twice
    assert sorted(map(tuple, intervals.members(intervals.ranges_of(starts, tree), ["start_id"], tree).na.fill("").collect())) == want


def test_chapters_go_on_at_the_last_finished_level(spark, tmp_path):
    nodes = spark.createDataFrame([(i, f"t{i}") for i in range(12)], "id int, title string")
    parents = spark.createDataFrame([(i, i - 1) for i in range(2, 12)], "child int, parent int")
    labels = spark.createDataFrame([(1, "01 - t1")], "id int, chapitre string")
    first, second = (scaling.Rounds(spark, f"file://{tmp_path}/walk") for _ in range(2))
    hierarchy.chapters(nodes, parents, labels, 4, first)
    found = {r.id: r.chapitre for r in hierarchy.chapters(nodes, parents, labels, 8, second).collect()}
    assert first.computed == [f"niveau-{k}" for k in range(1, 5)] and second.computed == [f"niveau-{k}" for k in range(5, 9)]
    assert found[8] == "01 - t1" and found[9] == found[0] == hierarchy.UNKNOWN_CHAPTER


def test_empty_tables(spark):
    nodes, edges = frames(spark, {1: "a"}, [(1, 1)])
    tree = intervals.label(nodes.limit(0), edges)
    assert tree.ranked.collect() == [] and not tree.joined
    assert intervals.members(intervals.ranges_of(nodes.select(F.col("id").alias("start_id")), tree), ["start_id"], tree).collect() == []
    assert [tuple(r) for r in hierarchy.descendants(nodes.select(F.col("id").alias("start_id")), nodes, edges).collect()] == [(1, 1, "a")]
