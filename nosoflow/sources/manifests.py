"""Tables as lists of files, so that a change rewrites only the files it touches.

Below a base folder, ``data`` holds Parquet files that are never changed, and ``manifest/v=N`` the files of each table at version N. Readers take the newest version that was
written to its end; a version covers all tables, so a change of several of them is seen as a whole or not at all. What a lost driver leaves is read by no one, and
``roll_back`` removes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nosoflow.operators.scaling import lookup_join

MANIFEST = "nom string, fichier string"


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, base: str) -> list[int]:
    """Versions written to their end, in order."""
    pattern, store = _path(spark, f"{base}/manifest/v=*/_SUCCESS")
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in store.globStatus(pattern) or [])


def files(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """``nom``, ``fichier`` of the newest or the given version."""
    known = versions(spark, base)
    if not known:
        raise FileNotFoundError(f"no version below {base}")
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifest/v={known[-1] if version is None else version}")


def _paths(manifest: DataFrame, name: str) -> list[str]:
    """File names of a table: what Spark's own reader lists, too."""
    return [r.fichier for r in manifest.where(F.col("nom") == name).select("fichier").toLocalIterator()]


def _written(df: DataFrame, base: str) -> list[str]:
    folder = f"{base}/data/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder).inputFiles()


def _commit(spark: SparkSession, base: str, version: int, manifest: DataFrame) -> None:
    """Fails if somebody else has written this version meanwhile; the caller may start again from theirs."""
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{base}/manifest/v={version}")


def create(tables: Mapping[str, DataFrame], base: str) -> None:
    """Version 0."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, file) for name, table in tables.items() for file in _written(table, base)]
    _commit(spark, base, 0, spark.createDataFrame(rows, MANIFEST))


def read(spark: SparkSession, base: str, name: str, schema, version: int | None = None) -> DataFrame:
    """A table at the newest or the given version; no row if it has no file."""
    paths = _paths(files(spark, base, version), name)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def erase(spark: SparkSession, base: str, gone: Mapping[str, DataFrame], schemas: Mapping[str, object]) -> dict[str, int]:
    """A new version without the rows whose key is in ``gone`` (table to a DataFrame of one key column). Returns how many files of each table were rewritten.

    The key column alone is read to find the files with such rows; these files are read again and written without them, all others are taken over. Nothing
    is changed if no row is hit.
    """
    known = versions(spark, base)
    manifest = files(spark, base).persist()
    added: list[tuple[str, str]] = []
    dropped: list[tuple[str, str]] = []
    rewritten = {}
    for name, keys in gone.items():
        key, paths = keys.columns[0], _paths(manifest, name)
        hit = []
        if paths:
            rows = spark.read.schema(schemas[name]).parquet(*paths).select(key, F.col("_metadata.file_path").alias("fichier"))
            hit = [r.fichier for r in lookup_join(rows, keys.distinct(), key, "left_semi").select("fichier").distinct().toLocalIterator()]
        if hit:
            kept = lookup_join(spark.read.schema(schemas[name]).parquet(*hit), keys.distinct(), key, "left_anti")
            added += [(name, file) for file in _written(kept, base)]
            dropped += [(name, file) for file in hit]
        rewritten[name] = len(hit)
    if dropped:
        plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  one spelling of local paths
        out = spark.createDataFrame(dropped, MANIFEST).select("nom", plain("fichier").alias("_fichier"))
        left = manifest.withColumn("_fichier", plain("fichier")).join(out, ["nom", "_fichier"], "left_anti").drop("_fichier")
        _commit(spark, base, known[-1] + 1, left.unionByName(spark.createDataFrame(added, MANIFEST)))
    manifest.unpersist()
    return rewritten


def erase_patients(spark: SparkSession, base: str, erased: DataFrame, schemas: Mapping[str, object]) -> dict[str, int]:
    """A new version without the patients (``id_patient``) and everything that hangs on them: stays, reports, diagnoses."""
    patients = erased.select("id_patient").distinct()
    stays = lookup_join(read(spark, base, "sejour", schemas["sejour"]), patients, "id_patient", "left_semi").select("id_sejour").distinct()
    reports = lookup_join(read(spark, base, "crh", schemas["crh"]), stays, "id_sejour", "left_semi").select("id_crh").distinct()
    return erase(spark, base, {"patient_fictif": patients, "sejour": stays, "crh": reports, "diagnostic": reports}, schemas)


def roll_back(spark: SparkSession, base: str) -> int:
    """Removes unfinished versions and the data folders that no finished version names; returns how many folders went. Not while somebody writes."""
    known = versions(spark, base)
    used = set()
    for version in known:
        used |= {r.f for r in files(spark, base, version).select(F.element_at(F.split("fichier", "/"), -2).alias("f")).distinct().toLocalIterator()}
    count = 0
    for pattern, keep in ((f"{base}/data/*", used), (f"{base}/manifest/v=*", {f"v={v}" for v in known})):
        path, store = _path(spark, pattern)
        for status in store.globStatus(path) or []:
            if status.getPath().getName() not in keep:
                store.delete(status.getPath(), True)
                count += 1
    return count
