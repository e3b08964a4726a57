"""Joins, ordinals and checkpoints that hold when one key owns a third of the rows."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def _bytes(setting: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)\s*([bkmgt]?)b?", setting.strip().lower()).groups()
    return int(number) * _UNITS[unit]


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Catalyst's size estimate of ``df`` is within the session's broadcast limit."""
    limit = _bytes(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    try:
        estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except ValueError:  # after many joins of checkpoints the estimate has more digits than Python reads
        return False
    return 0 <= estimate <= limit


def lookup_join(facts: DataFrame, lookup: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join of a large, possibly skewed side with a lookup side. Each side is read once.

    A lookup whose estimated size is within the broadcast limit is broadcast: no shuffle, so no skew. Beyond it both sides are
    shuffled, and adaptive execution cuts the partitions of frequent and of null keys (``spark.sql.adaptive.skewJoin``).
    """
    keys = [on] if isinstance(on, str) else list(on)
    return facts.join(F.broadcast(lookup) if fits_broadcast(lookup) else lookup, keys, how)


def rows_fit_broadcast(spark: SparkSession, rows: int, row_bytes: int = 100) -> bool:
    """Whether a counted table of short rows is within the session's broadcast limit."""
    return rows * row_bytes <= _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))


def _running_total(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows before each bucket. Two levels, so that no window orders more than 1/1024 of the buckets at once."""
    counts = counts.withColumn("_block", F.floor(F.col("_bucket") / 1024))
    blocks = counts.groupBy(*by, "_block").agg(F.sum("_n").alias("_block_n"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*by, "_block", F.coalesce(F.sum("_block_n").over(before), F.lit(0)).alias("_before_block"))
    inside = Window.partitionBy(*by, "_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("_before_bucket", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return within.join(blocks, [*by, "_block"]).select(
        *by, "_bucket", (F.col("_before_block") + F.col("_before_bucket")).alias("_before")
    )


def ordinals(
    df: DataFrame, order: Sequence[str], bucket: Column, by: Sequence[str] = (), name: str = "pos"
) -> DataFrame:
    """Exact 1-based position of each row in ``order`` within ``by``, without one task per group.

    ``bucket`` is an integer that never decreases along ``order`` (a time slice, a range
    of ids). Rows are numbered inside a bucket and shifted by the rows of earlier
    buckets; only the bucket counts are summed along the whole order.
    """
    by = list(by)
    df = df.withColumn("_bucket", bucket.cast("bigint"))
    counts = df.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    if not by:
        df, counts = df.withColumn("_all", F.lit(0)), counts.withColumn("_all", F.lit(0))
        by = ["_all"]
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(inside))
    return (
        numbered.join(_running_total(counts, by), [*by, "_bucket"])
        .withColumn(name, (F.col("_before") + F.col("_rn")).cast("bigint"))
        .drop("_bucket", "_rn", "_before", "_all")
    )


def rolling_rows(
    df: DataFrame, by: Sequence[str], position: str, rows: int, values: dict[str, Column], chunk: int = 10_000
) -> DataFrame:
    """Aggregates over the last ``rows`` rows per group, in chunks of bounded size.

    Every group is cut into chunks of ``chunk`` positions; the last ``rows - 1`` rows of a
    chunk are repeated at the head of the next one. A task never holds more than
    ``chunk + rows`` rows of a group, and each result equals the uncut window.
    ``values`` maps a result name to an aggregate expression.
    """
    own = F.floor((F.col(position) - 1) / chunk)
    offset = F.pmod(F.col(position) - 1, F.lit(chunk))
    homes = F.when(offset >= chunk - (rows - 1), F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.withColumn("_own", own).withColumn("_chunk", F.explode(homes))
    window = (
        Window.partitionBy(*by, "_chunk").orderBy(position).rowsBetween(-(rows - 1), Window.currentRow)
    )
    return (
        spread.withColumns({name: value.over(window) for name, value in values.items()})
        .where(F.col("_own") == F.col("_chunk"))
        .drop("_own", "_chunk")
    )


def spread_small(df: DataFrame) -> DataFrame:
    """Give an input of fewer partitions than cores one partition per core, before heavy work per row.

    A large input already has more partitions than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor reaches: the cluster's checkpoint folder.

    On a local master with nothing configured it is a folder of the warehouse; a cluster without the setting is an error, as nothing
    tells which folder is shared. Checkpoint files go when their table is no longer used, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run, in the folder shared by the executors. It is removed when the driver ends; until then results may read it."""
    base = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            path = jvm.org.apache.hadoop.fs.Path(base)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # noqa: BLE001  the session has ended
            pass

    atexit.register(remove)
    return base


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the plan restarts from files that outlive any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Rounds:
    """Rounds of a walk kept under a run's name: a second start reads those that were finished and goes on with the next one.

    A round is finished once Spark has marked its folder (``_SUCCESS``); a folder without the mark is written again. The inputs must be the same at every start.
    ``computed`` names the rounds that this start has made.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.computed: list[str] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark):
            df.write.mode("overwrite").parquet(path)
            self.computed.append(name)
        return self.spark.read.schema(df.schema).parquet(path)


Keep = Callable[[DataFrame, str], DataFrame]


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """A round that is not kept beyond the application."""
    return cut_lineage(df)


def concat_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
