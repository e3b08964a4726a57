"""Seeded samples. The draw depends on a hash of the row's key, so a retried task draws alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nosoflow.operators.relational import first_per_key
from nosoflow.operators.scaling import cut_lineage, lookup_join, ordinals
from nosoflow.operators.selection import first_rows

# Roots with more items are numbered in slices of the hash range.
LARGE_ROOT_ITEMS = 100_000


def hash_number(seed: int, *keys: str | Column) -> Column:
    """52-bit number from MD5 of the seed and the keys: ties are rare up to some 10^7 rows, and keys break them."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def uniform(seed: int, *keys: str) -> Column:
    """Number in (0, 1), never 0, so its logarithm exists."""
    return (hash_number(seed, *keys) + F.lit(0.5)) / F.lit(float(2**52))


def weighted_sample(df: DataFrame, n: int, weight: str, key: str, seed: int) -> DataFrame:
    """``n`` rows without replacement, with chances proportional to a weight (exponential keys)."""
    arrival = -F.log(uniform(seed, key)) / F.col(weight)
    drawn = df.where(F.col(weight) > 0).withColumn("_arrival", arrival)
    return first_rows(drawn, ["_arrival", key], n).drop("_arrival")


def seeded_sample(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """``n`` rows, all equally likely."""
    return first_rows(df.withColumn("_h", hash_number(seed, key)), ["_h", key], n).drop("_h")


def draw_per_key(candidates: DataFrame, keys: Sequence[str], item: str, k: int, seed: int) -> DataFrame:
    """Up to ``k`` distinct items per key. Each map task passes on at most ``k`` of them per key."""
    distinct = candidates.select(*keys, item).distinct().withColumn("_h", hash_number(seed, *keys, item))
    return first_per_key(distinct, keys, ["_h", item], k).drop("_h")


def _distinct_positions(seed: int, key: str, n: Column, k: int) -> Column:
    """``min(k, n)`` distinct numbers from 1 to ``n``, every set equally likely (Floyd's method), from hashes of the row and the slot."""

    def draw(taken: Column, slot: Column) -> Column:
        last = n - k + 1 + slot  # the number of a slot is drawn from 1 to this; slots without one are left out
        number = F.pmod(hash_number(seed, key, slot), last) + 1
        return F.concat(taken, F.array(F.when(F.array_contains(taken, number), last).otherwise(number)))

    slots = F.sequence(F.greatest(k - n, F.lit(0)).cast("bigint"), F.lit(k - 1).cast("bigint"))
    return F.aggregate(slots, F.array().cast("array<bigint>"), draw)


def draw_for_rows(
    rows: DataFrame, key: str, root: str, candidates: DataFrame, item: str, k: int, seed: int
) -> DataFrame:
    """Up to ``k`` distinct items of its root for every row, each row drawing on its own.

    The items of a root are put in hash order and numbered; a row draws ``k`` distinct positions, independently of all other
    rows. It meets ``k`` items, never all items of its root. Columns ``key``, ``root``, ``item``. Candidates of roots that no row has are not numbered.
    """
    rows = cut_lineage(rows.select(key, root))
    asked = rows.select(root).distinct()
    distinct = lookup_join(candidates.select(root, item), asked, root, "left_semi").distinct()
    distinct = cut_lineage(distinct.withColumn("_h", hash_number(seed, root, item)))  # read for sizes, slices and numbers, made once
    sizes = cut_lineage(distinct.groupBy(root).agg(F.count(F.lit(1)).alias("_n")))
    hashed = lookup_join(distinct, sizes, root, "inner")
    slices = F.when(F.col("_n") > LARGE_ROOT_ITEMS, F.floor(F.col("_h") / 2**38)).otherwise(F.lit(0))
    numbered = ordinals(hashed, ["_h", item], slices, by=[root], name="_pos").select(root, item, "_pos")
    sized = lookup_join(rows, sizes, root, "inner")
    placed = sized.select(key, root, F.explode(_distinct_positions(seed, key, F.col("_n"), k)).alias("_pos"))
    return lookup_join(placed, numbered, [root, "_pos"], "inner").select(key, root, item)
