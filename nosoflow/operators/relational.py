"""Small relational building blocks: keep-first, keep-last, search, pages, top-k."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nosoflow.operators.scaling import concat_all
from nosoflow.operators.selection import first_rows


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, k: int = 1) -> DataFrame:
    """First ``k`` rows per key in an explicit order.

    Spark limits each group on the map side before the shuffle, so a key that owns
    most rows sends at most ``k`` of them per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def keep_last_map(df: DataFrame, key: Column, value: Column, order: Sequence[str]) -> DataFrame:
    """Dictionary built row by row: the last value written under a key wins. Columns ``key``, ``value``."""
    rows = df.select(key.alias("key"), value.alias("value"), F.struct(*order).alias("ord"))
    return rows.groupBy("key").agg(F.max_by("value", "ord").alias("value"))


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def keep_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def official_titles(terms: DataFrame, columns: Sequence[str]) -> DataFrame:
    return terms.where(F.col("type") == "title").select(*columns).distinct()


def optional_filter(df: DataFrame, predicate: str | Column | None) -> DataFrame:
    return df if predicate is None else df.where(predicate)


def drop_codes(df: DataFrame, code: str, *, prefix: str | None = None, endings: Sequence[str] = ()) -> DataFrame:
    if prefix:
        df = df.where(~F.startswith(F.col(code), F.lit(prefix)))
    for ending in endings:
        df = df.where(~F.endswith(F.col(code), F.lit(ending)))
    return df


def search(df: DataFrame, column: str, query: str | None) -> DataFrame:
    """Case-insensitive contains; ``%`` and ``_`` in the query stay wildcards; no query keeps all."""
    return df if not query else df.where(F.col(column).ilike("%" + query + "%"))


def page(df: DataFrame, order: Sequence, limit: int, offset: int = 0, cap: int = 500, deepest: int = 100_000) -> DataFrame:
    """One ordered page; the limit may not exceed the page cap. Offset and limit together are the rows that one task holds, so the
    offset is bounded too: beyond ``deepest`` use ``page_after``."""
    if not 0 < limit <= cap or not 0 <= offset <= deepest:
        raise ValueError(f"limit must be in 1..{cap} and offset in 0..{deepest}")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, key: str, last, limit: int, cap: int = 500) -> DataFrame:
    """The page that follows the row with key ``last`` (None: the first page). Costs the same at any depth."""
    if not 0 < limit <= cap:
        raise ValueError(f"limit must be in 1..{cap}")
    rest = df if last is None else df.where(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(limit)


def find(df: DataFrame, column: str, value) -> DataFrame:
    """Point lookup; no row means not found."""
    return df.where(F.col(column) == F.lit(value))


def load_limit(df: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """First ``limit`` accepted rows in file order; zero keeps all. A large limit is no task of its own (``selection.first_rows``)."""
    return first_rows(df, order, limit) if limit else df


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def top_counts(df: DataFrame, key: str, k: int, name: str = "n") -> DataFrame:
    """``k`` most frequent keys, ties by key."""
    return count_by(df, [key], name).orderBy(F.desc(name), key).limit(k)


def group_size_distribution(df: DataFrame, keys: Sequence[str], size: str, name: str = "n") -> DataFrame:
    """How many groups have each size."""
    return count_by(count_by(df, keys, size), [size], name)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table, one line each."""
    return concat_all([t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
                       for n, t in tables.items()])
