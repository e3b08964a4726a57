"""Session factory. Queries never depend on it: any SparkSession works."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(
    app: str = "nosoflow", master: str | None = None, shuffle_partitions: int | None = None, **conf: str
) -> SparkSession:
    """Session with adaptive execution, skew handling and UTC timestamps.

    ``master`` and ``shuffle_partitions`` are left to the cluster unless given.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if os.environ.get("SPARK_CHECKPOINT_DIR"):
        builder = builder.config("spark.checkpoint.dir", os.environ["SPARK_CHECKPOINT_DIR"])
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
