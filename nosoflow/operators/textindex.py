"""Contains search by inverted lists of trigrams.

The index has a row for each key and each different run of three characters of its lower-case text, in folders by a hash of the run. A query's wildcards part it into
pieces; a text that matches holds all runs of all pieces, so only their lists are read, and the few texts that hold them all are compared with the whole pattern.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nosoflow.operators.relational import search
from nosoflow.operators.scaling import lookup_join

RUN, GROUPS = 3, 256
GROUP = "groupe"


def runs(text: Column) -> Column:
    """Different runs of three characters of the lower-case text; none for a shorter one or null."""
    low = F.lower(text)
    places = F.when(F.length(low) >= RUN, F.sequence(F.lit(1), F.length(low) - (RUN - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(low, i, RUN)))


def _group(run: Column) -> Column:
    return (F.crc32(run.cast("binary")) % GROUPS).cast("int")


def build(df: DataFrame, key: str, column: str, path: str) -> None:
    """Write the index of ``column`` below ``path``. A frequent run is spread over tasks by its keys, and its list over files."""
    rows = df.where(F.col(key).isNotNull()).select(key, F.explode(runs(F.col(column))).alias("suite")).distinct().withColumn(GROUP, _group(F.col("suite")))
    rows.repartition(GROUP, F.pmod(F.xxhash64(key), F.lit(16))).sortWithinPartitions(GROUP, "suite").write.mode("overwrite").partitionBy(GROUP).parquet(path)


def required(spark: SparkSession, query: str) -> list[str]:
    """Runs that every match holds; none for a query of short pieces, or with escaped wildcards."""
    if "\\" in query:
        return []
    low = spark.range(1).select(F.lower(F.lit(query))).first()[0]  # by the same rules as the texts
    return sorted({p[i:i + RUN] for p in re.split("[%_]", low) for i in range(len(p) - RUN + 1)})


def candidates(spark: SparkSession, path: str, key: str, asked: list[str]) -> DataFrame:
    """Keys whose text holds all of the runs ``asked``."""
    groups = sorted({zlib.crc32(run.encode()) % GROUPS for run in asked})
    lists = spark.read.option("basePath", path).parquet(path).where(F.col(GROUP).isin(groups) & F.col("suite").isin(asked))
    return lists.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(asked)).select(key)


def indexed_search(df: DataFrame, key: str, column: str, query: str | None, path: str) -> DataFrame:
    """What ``relational.search`` finds in ``df``, whose index is below ``path``. Without a run of three characters in the query all rows are searched."""
    spark = df.sparkSession
    asked = required(spark, query) if query else []
    if not asked:
        return search(df, column, query)
    found = candidates(spark, path, key, asked)
    return search(lookup_join(df, found, key, "left_semi"), column, query)
