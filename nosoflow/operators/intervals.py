"""Interval labels of a terminology: descendants as ranges of an order of all nodes.

Each node keeps one parent, so the nodes form trees; all nodes are put into the order of a walk through these trees, where the descendants of a node follow it without a
gap. A node then stands for a range, and ranges of two nodes are nested or disjoint. The other parents are few: an edge from one of them adds the
child's range to those of all nodes above its parent. Loops are cut at their least node, whose edge is then one of these others.

No table of (start, descendant) is built to count descendants; such rows are made on request, from the ranges of chosen starts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nosoflow.operators.scaling import Keep, checkpointed, cut_lineage, lookup_join, ordinals

#: Places of a range that one row is taken apart into at a time.
CHUNK = 10_000


@dataclass(frozen=True)
class Intervals:
    """Nodes by place (``place, id, code``); their ranges (``id, low, n, n_coded, path``); ranges that other parents add (``id, head``), none if ``joined`` is false."""

    ranked: DataFrame
    spans: DataFrame
    heads: DataFrame
    joined: bool


def _open(rows: DataFrame) -> int:
    return rows.where("up IS NOT NULL").count()


def _paths(parents: DataFrame, keep: Keep, name: str) -> tuple[DataFrame, bool]:
    """id, up, path: the nodes from the top to each node; and whether some lead into a loop, which have no top.

    Each round doubles the length of the paths, so there are as many as the logarithm of the depth. While nodes are left that have a top, a round completes some.
    """
    rows, number = keep(parents.select("id", "up", F.array("id").alias("path")), f"{name}-0"), 0
    left = _open(rows)
    while left:
        number += 1
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        longer = lookup_join(rows.where("up IS NOT NULL"), above, "up", "inner")
        longer = longer.select("id", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"))
        rows = keep(rows.where("up IS NULL").unionByName(longer), f"{name}-{number}")
        before, left = left, _open(rows)
        if left == before:
            return rows, True
    return rows, False


def _loop_heads(parents: DataFrame, stuck: DataFrame, keep: Keep) -> DataFrame:
    """id: the least node of every loop that the nodes ``stuck`` lead into."""
    rows = keep(parents.join(stuck.select("id"), "id", "left_semi").select("id", "up", F.col("id").alias("least")), "boucles-1")
    steps, count = 1, rows.count()
    while steps < count:
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("least").alias("_least"))
        steps *= 2
        rows = keep(lookup_join(rows, above, "up", "inner").select("id", F.col("_up").alias("up"), F.least("least", "_least").alias("least")), f"boucles-{steps}")
    inside = rows.select(F.col("up").alias("id")).distinct()
    return rows.join(inside, "id", "left_semi").select(F.col("least").alias("id")).distinct()


def label(nodes: DataFrame, edges: DataFrame, keep: Keep = checkpointed) -> Intervals:
    """Ranges of all nodes (``id`` unique, ``code``) under ``edges`` (``parent, child``).

    Edges with an unknown end, repeated ones and edges from a node to itself change nothing. Paths are as long as the tree is deep; each node has one. With
    ``scaling.Rounds`` as ``keep``, a start after a failure goes on at the last finished round.
    """
    ids = nodes.select("id")
    links = edges.select("parent", "child").where("parent <> child").distinct()
    for end in ("parent", "child"):
        links = lookup_join(links, ids.withColumnRenamed("id", end), end, "left_semi")
    links = keep(links, "liens")
    first = links.groupBy("child").agg(F.min("parent").alias("up")).withColumnRenamed("child", "id")
    parents = keep(ids.join(first, "id", "left"), "parents")
    paths, looped = _paths(parents, keep, "chemins")
    if looped:
        cut = _loop_heads(parents, paths.where("up IS NOT NULL"), keep).withColumn("_cut", F.lit(True))
        parents = keep(parents.join(cut, "id", "left").select("id", F.when(F.col("_cut").isNull(), F.col("up")).alias("up")), "arbres")
        paths, _ = _paths(parents, keep, "chemins-arbres")

    named = paths.select("id", "path").join(nodes.select("id", "code"), "id")
    dealt = keep(named.repartitionByRange("path").withColumn("_part", F.spark_partition_id()), "tries")
    ordered = keep(ordinals(dealt, ["path"], F.col("_part"), name="place").drop("_part"), "rangs")
    ranges = ordered.select("place", "code", F.explode("path").alias("id")).groupBy("id").agg(
        F.min("place").alias("low"), F.count(F.lit(1)).alias("n"), F.count("code").alias("n_coded"))
    spans = keep(ranges.join(ordered.select("id", "path"), "id"), "plages")

    kept = parents.where("up IS NOT NULL").select(F.col("id").alias("child"), F.col("up").alias("parent"))
    others = links.join(kept, ["parent", "child"], "left_anti")
    tails = others.join(spans.select(F.col("id").alias("parent"), "path"), "parent").select("child", F.explode("path").alias("id"))
    tops = spans.select(F.col("id").alias("child"), F.col("path").alias("_path"))
    heads = tails.join(tops, "child").where(~F.array_contains("_path", F.col("id"))).select("id", F.col("child").alias("head")).distinct()
    heads = keep(heads, "renvois")
    return Intervals(ordered.select("place", "id", "code"), spans, heads, not heads.isEmpty())


def ranges_of(starts: DataFrame, tree: Intervals) -> DataFrame:
    """start_id, head: nodes whose ranges together hold what each distinct start reaches; a start outside the tree has none.

    One row for each start, and one for each other parent's child that it leads to. A start and head met before are never followed again.
    """
    first = starts.select("start_id").distinct().join(tree.spans.select(F.col("id").alias("start_id")), "start_id", "left_semi")
    reached = first.select("start_id", F.col("start_id").alias("head"))
    if not tree.joined:
        return reached
    reached = frontier = cut_lineage(reached)
    while not frontier.isEmpty():
        step = lookup_join(frontier.select("start_id", F.col("head").alias("id")), tree.heads, "id", "inner").select("start_id", "head").distinct()
        frontier = cut_lineage(step.join(reached, ["start_id", "head"], "left_anti"))
        reached = reached.unionByName(frontier)
    return reached


def disjoint(rows: DataFrame, keys: Sequence[str], tree: Intervals) -> DataFrame:
    """``keys`` and ``head`` without the ranges that another range of the same keys holds: the others share no node."""
    rows = cut_lineage(rows.select(*keys, "head").distinct())
    several = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    placed = rows.join(several, list(keys), "left_semi").join(tree.spans.select(F.col("id").alias("head"), "path"), "head")
    above = placed.select(*keys, "head", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("_above"))
    inside = above.join(rows.select(*keys, F.col("head").alias("_above")), [*keys, "_above"], "left_semi").select(*keys, "head").distinct()
    return rows.join(inside, [*keys, "head"], "left_anti")


def sizes(rows: DataFrame, keys: Sequence[str], tree: Intervals) -> DataFrame:
    """``keys`` and ``n``: coded nodes in the ranges of ``rows`` (keys, head), each counted once."""
    spans = tree.spans.select(F.col("id").alias("head"), "n_coded")
    return lookup_join(disjoint(rows, keys, tree), spans, "head", "inner").groupBy(*keys).agg(F.sum("n_coded").alias("n"))


def members(rows: DataFrame, keys: Sequence[str], tree: Intervals) -> DataFrame:
    """``keys``, ``id``, ``code``: the nodes in the ranges of ``rows`` (keys, head), each once."""
    spans = tree.spans.select(F.col("id").alias("head"), "low", "n")
    spread = lookup_join(disjoint(rows, keys, tree), spans, "head", "inner").withColumn("_end", F.col("low") + F.col("n") - 1)
    spread = spread.withColumn("_from", F.explode(F.sequence("low", "_end", F.lit(CHUNK).cast("bigint"))))
    places = spread.withColumn("place", F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK - 1, "_end"))))
    return lookup_join(places.select(*keys, "place"), tree.ranked, "place", "inner").select(*keys, "id", "code")
