"""Dictionary lookups on codes: back-off translation, lists, cross-checks, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nosoflow.functions.codes import backoff_candidates, is_residual, normalize_icd10
from nosoflow.functions.text import strip
from nosoflow.operators.relational import keep_last_map
from nosoflow.operators.scaling import fits_broadcast, lookup_join


def translation_map(mapping: DataFrame, order: Sequence[str]) -> DataFrame:
    """Normalised ICD-10 key to stripped ICD-11 code, last row of a key wins."""
    complete = mapping.dropna(subset=["icd10", "icd11"])
    kept = keep_last_map(complete, normalize_icd10(F.col("icd10")), strip(F.col("icd11")), order)
    return kept.select(F.col("key").alias("icd10_norm"), F.col("value").alias("icd11"))


def translate(df: DataFrame, code: str, mapping: DataFrame, result: str = "icd11", exact: str | None = None) -> DataFrame:
    """Translate an ICD-10 column with back-off; null when no candidate maps. ``exact`` names a flag for rows found without back-off.

    With a small map three broadcast lookups run on the rows themselves, without
    shuffle. With a large one the distinct codes are resolved first, then attached
    to the rows by one join, so each row is shuffled once.
    """
    names = ("_k1", "_k2", "_k3")

    def resolve(rows: DataFrame) -> DataFrame:
        for i, (name, candidate) in enumerate(zip(names, backoff_candidates(F.col(code)))):
            keyed = mapping.select(F.col("icd10_norm").alias(name), F.col("icd11").alias(f"_v{i}"))
            rows = lookup_join(rows.withColumn(name, candidate), keyed, name, "left")
        found = rows.withColumn(result, F.coalesce("_v0", "_v1", "_v2"))
        return (found.withColumn(exact, F.col("_v0").isNotNull()) if exact else found).drop(*names, "_v0", "_v1", "_v2")

    if fits_broadcast(mapping):
        return resolve(df)
    return lookup_join(df, resolve(df.select(code).distinct()), code, "left")


def translate_lists(df: DataFrame, key: str, codes: str, mapping: DataFrame, result: str) -> DataFrame:
    """Translate the codes of an array column, dropping blanks, misses and residual codes, in order.

    A null list stays null and an emptied list stays empty. ``key`` identifies the row,
    so a rebuilt list is never longer than the list it came from.
    """
    items = df.select(key, F.posexplode(F.col(codes)).alias("_pos", "_code")).where(strip(F.col("_code")) != "")
    mapped = translate(items, "_code", mapping, "_icd11").where(F.col("_icd11").isNotNull() & ~is_residual(F.col("_icd11")))
    lists = mapped.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_icd11"))).alias("_list"))
    kept = F.transform(F.coalesce(F.col("_list"), F.array()), lambda x: x["_icd11"])
    return df.join(lists, key, "left").withColumn(result, F.when(F.col(codes).isNotNull(), kept)).drop("_list")


def specific_profiles(profiles: DataFrame, code: str, mapping: DataFrame) -> DataFrame:
    """Profiles with an ICD-11 code that is neither missing nor residual."""
    translated = translate(profiles, code, mapping).dropna(subset=["icd11"])
    return translated.where(~is_residual(F.col("icd11")))


def conversion_rates(profiles: DataFrame, code: str, mapping: DataFrame) -> DataFrame:
    """Rows, rows translated exactly, with back-off, and kept after the residual filter, as counts and shares."""
    rows = translate(profiles, code, mapping, exact="_hit")
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_hit")).alias("n_exact"),
        F.count_if(F.col("icd11").isNotNull()).alias("n_backoff"),
        F.count_if(~is_residual(F.col("icd11"))).alias("n_specific"),
    )
    return counts.withColumns({
        f"pct_{c}": F.round(F.lit(100.0) * F.col(f"n_{c}") / F.col("n"), 1) for c in ("exact", "backoff", "specific")
    })


def crosscheck(predictions: DataFrame, code: str, codes: DataFrame) -> DataFrame:
    """Official label of each predicted code and whether the terminology knows it."""
    official = codes.select(F.col("code").alias(code), F.col("libelle").alias("libelle_officiel"), F.lit(True).alias("_known"))
    return lookup_join(predictions, official, code, "left").withColumn(
        "trouve", F.coalesce(F.col("_known"), F.lit(False))).drop("_known")


def with_fallback(df: DataFrame, key: str, found: DataFrame, column: str, fallback: Column) -> DataFrame:
    """Left lookup of ``column``; the fallback where nothing is found."""
    return lookup_join(df, found, key, "left").withColumn(column, F.coalesce(F.col(column), fallback))


def apply_verdicts(rows: DataFrame, verdicts: DataFrame, keys: Sequence[str], accept: str = "OUI") -> DataFrame:
    """Drop rows whose verdict is present and not the accepting word; a missing verdict keeps the row."""
    rejected = verdicts.where(F.col("verdict").isNotNull() & (F.upper(strip(F.col("verdict"))) != accept))
    return lookup_join(rows, rejected.select(*keys).distinct(), keys, "left_anti")


def apply_group_verdicts(
    rows: DataFrame, verdicts: DataFrame, group: str, code: str, none_word: str = "AUCUN"
) -> DataFrame:
    """Drop the codes that a group verdict lists (comma separated); groups of one row are left alone."""
    reply = F.upper(strip(F.col("verdict")))
    listed = (
        verdicts.where(reply != none_word)
        .select(group, F.explode(F.split(reply, ",")).alias("_code"))
        .select(group, strip(F.col("_code")).alias(code)).distinct()
    )
    several = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(group)
    rejected = listed.join(several, group, "left_semi")
    return lookup_join(rows, rejected, [group, code], "left_anti")


def remaining(units: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Units of work whose key is not in the table of finished keys."""
    return lookup_join(units, finished.select(key).distinct(), key, "left_anti")
