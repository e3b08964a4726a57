"""Connected components of a large graph, by joins and reliable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nosoflow.llm.common import stored


def _toward_least(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least node around it."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _toward_smaller(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of these. ``edges`` lead from the larger to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def _summary(edges: DataFrame) -> tuple:
    """Equal summaries mean, but for a chance of 2^-64, equal sets of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (a, b); nodes that are their own root are left out.

    Alternates two steps that tie neighbours to smaller nodes until nothing changes, which takes a number of rounds in the order of
    the squared logarithm of the nodes. Each round is two aggregations and two joins on narrow rows, written to the shared folder, so lineage
    stays short. No component is gathered anywhere: a node with very many neighbours is one key of a join, which Spark splits.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = stored(current, f"{name}-0")
    before, number = _summary(current), 0
    while before[0]:
        number += 1
        current = stored(_toward_smaller(_toward_least(current)), f"{name}-{number}")
        after = _summary(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
