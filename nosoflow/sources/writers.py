"""Writers. Output is written by the executors; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: rows per insert of a database load.
INSERT_BATCH = 5000
BOM = "﻿"


def write_csv(df: DataFrame, path: str, delimiter: str = ",", bom: bool = False) -> None:
    """CSV with header. ``bom`` starts each part with a byte-order mark, for spreadsheets."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    df.write.mode("overwrite").csv(path, header=True, sep=delimiter, quote='"', escape='"')


def write_small_csv(df: DataFrame, path: str, order: Sequence, rows: int) -> None:
    """One CSV file for a top-k report; the row limit is the report's own size."""
    df.orderBy(*order).limit(rows).coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def append_table(df: DataFrame, url: str, table: str, **properties: str) -> None:
    """Append to a database table in batches, one connection per partition."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option(
        "batchsize", INSERT_BATCH).options(**properties).mode("append").save()


def write_lines(df: DataFrame, path: str) -> None:
    """One text line per row of a single string column, for instance JSON requests."""
    df.write.mode("overwrite").text(path)


def run_folder(base: str, moment: datetime | None = None) -> str:
    stamp = (moment or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    return f"{base.rstrip('/')}/run_id={stamp}"


def write_run(df: DataFrame, base: str, moment: datetime | None = None) -> str:
    """Parquet in a folder of its own per run; returns the folder."""
    folder = run_folder(base, moment)
    df.write.parquet(folder)
    return folder


def record_finished(units: DataFrame, manifest: str, key: str) -> None:
    """Add finished keys to the manifest that ``remaining`` reads on the next run."""
    units.select(key, F.current_timestamp().alias("fini_le")).write.mode("append").parquet(manifest)


def read_manifest(spark: SparkSession, manifest: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(manifest)
