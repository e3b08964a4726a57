"""ICD-10 to ICD-11 translation of scenario profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nosoflow.operators import lookup, relational
from nosoflow.plans.registry import query
from nosoflow.plans.views import Inputs

NORM = "CASE WHEN contains(trim({c}), '.') OR length(trim({c})) < 4 THEN trim({c}) ELSE left(trim({c}), 3) || '.' || substr(trim({c}), 4) END"
MAP = f"""map AS (SELECT {NORM.format(c='icd10')} AS k, max_by(trim(icd11), ord) AS v FROM v_map10 GROUP BY 1)"""
LOOKUP = """coalesce((SELECT v FROM map WHERE k = {n}),
  CASE WHEN contains({n}, '.') THEN coalesce((SELECT v FROM map WHERE k = left({n}, length({n}) - 1)),
  (SELECT v FROM map WHERE k = split_part({n}, '.', 1))) END)"""
PROFILES = f"""{MAP}, prof AS (SELECT *, {LOOKUP.format(n='norm')} AS icd11 FROM (
  SELECT *, {NORM.format(c='icd10_raw')} AS norm FROM v_profile))"""
SPECIFIC = "icd11 IS NOT NULL AND right(icd11, 1) NOT IN ('Y', 'Z')"


def mapping(i: Inputs) -> DataFrame:
    return lookup.translation_map(i("v_map10"), ["ord"])


def specific(i: Inputs) -> DataFrame:
    return lookup.specific_profiles(i("v_profile"), "icd10_raw", mapping(i))


def with_lists(i: Inputs) -> DataFrame:
    profiles = i("v_profile").withColumn("codes", F.split("icd10_sec", ","))
    return lookup.translate_lists(profiles, "id", "codes", mapping(i), "icd11_sec")


@query(f"WITH {PROFILES} SELECT id, icd10_raw, icd11, nb FROM prof WHERE {SPECIFIC}")
def translate_profiles(i: Inputs) -> DataFrame:
    return relational.keep_columns(specific(i), ["id", "icd10_raw", "icd11", "nb", "cage"])


@query(f"""
    WITH {MAP}, items AS (SELECT id, pos, {NORM.format(c='code')} AS norm FROM (
        SELECT id, unnest(string_split(icd10_sec, ',')) AS code, generate_subscripts(string_split(icd10_sec, ','), 1) AS pos
        FROM v_profile WHERE icd10_sec IS NOT NULL) WHERE trim(code) <> ''),
      mapped AS (SELECT id, pos, {LOOKUP.format(n='norm')} AS icd11 FROM items),
      lists AS (SELECT id, string_agg(icd11, ',' ORDER BY pos) AS l, count(*) AS n FROM mapped WHERE {SPECIFIC} GROUP BY id)
    SELECT p.id, CASE WHEN p.icd10_sec IS NULL THEN NULL ELSE coalesce(l.l, '') END AS icd11_sec,
      CASE WHEN p.icd10_sec IS NULL THEN NULL ELSE coalesce(l.n, 0) END AS n
    FROM v_profile p LEFT JOIN lists l ON l.id = p.id""")
def translate_lists(i: Inputs) -> DataFrame:
    rows = with_lists(i)
    size = F.when(F.col("icd11_sec").isNotNull(), F.size("icd11_sec").cast("bigint"))
    return rows.select("id", F.array_join("icd11_sec", ",").alias("icd11_sec"), size.alias("n"))


@query(f"""
    WITH {PROFILES}, c AS (SELECT count(*) AS n, count(*) FILTER (norm IN (SELECT k FROM map)) AS n_exact,
      count(icd11) AS n_backoff, count(*) FILTER ({SPECIFIC}) AS n_specific FROM prof)
    SELECT *, round(100.0 * n_exact / n, 1) AS pct_exact, round(100.0 * n_backoff / n, 1) AS pct_backoff,
      round(100.0 * n_specific / n, 1) AS pct_specific FROM c""")
def conversion_rates(i: Inputs) -> DataFrame:
    return lookup.conversion_rates(i("v_profile"), "icd10_raw", mapping(i))


@query("SELECT id, icd10_raw AS icd_primary_code, los, admission_type FROM v_profile WHERE los IS NOT NULL AND nb > 20")
def filtered_profiles(i: Inputs) -> DataFrame:
    complete = i("v_profile").dropna(subset=["icd10_raw", "los"])
    kept = relational.optional_filter(complete, "nb > 20")
    renamed = relational.rename(kept, {"icd10_raw": "icd_primary_code"})
    return relational.keep_columns(renamed, ["id", "icd_primary_code", "los", "admission_type", "age"])


@query("""SELECT admission_type, count(*) AS n FROM v_profile GROUP BY 1""")
def admission_counts(i: Inputs) -> DataFrame:
    return relational.count_by(i("v_profile"), ["admission_type"]).orderBy(F.desc("n"), "admission_type")


@query("""
    SELECT id, strftime(d, '%d/%m/%Y') AS date_entry, strftime(d + to_days(CAST(o_custkey % 12 AS INTEGER)), '%d/%m/%Y') AS date_discharge,
      o_custkey % 12 AS duree, coalesce(o_custkey % 12 = id % 12, false) AS coherent
    FROM (SELECT o_orderkey AS id, o_orderdate AS d, o_custkey FROM orders)""")
def stay_length_check(i: Inputs) -> DataFrame:
    from nosoflow.operators.stays import stay_length

    orders = i.table("orders")
    day = F.to_date("o_orderdate")
    stays = orders.select(
        F.col("o_orderkey").alias("id"), F.date_format(day, "dd/MM/yyyy").alias("date_entry"),
        F.date_format(F.date_add(day, (F.col("o_custkey") % 12).cast("int")), "dd/MM/yyyy").alias("date_discharge"),
        (F.col("o_orderkey") % 12).alias("los"))
    return stay_length(stays, "date_entry", "date_discharge", "los").select("id", "date_entry", "date_discharge", "duree", "coherent")
