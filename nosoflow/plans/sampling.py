"""Seeded samples; the oracle recomputes the same hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from nosoflow.operators import sampling
from nosoflow.plans.registry import query
from nosoflow.plans.views import Inputs

HASH = "CAST('0x' || left(md5({}), 13) AS BIGINT)"


@query(f"""SELECT id, icd10_raw, nb FROM v_profile
    ORDER BY -ln(({HASH.format("'7|' || id")} + 0.5) / 4503599627370496.0) / nb, id LIMIT 500""")
def weighted_sample(i: Inputs) -> DataFrame:
    return sampling.weighted_sample(i("v_profile"), 500, "nb", "id", 7).select("id", "icd10_raw", "nb")


@query(f"""SELECT id, icd10_raw, nb FROM v_profile
    ORDER BY -ln(({HASH.format("'8|' || id")} + 0.5) / 4503599627370496.0) / nb, id LIMIT 12000""")
def large_weighted_sample(i: Inputs) -> DataFrame:
    """More rows than one task should sort: chosen by histograms of the keys."""
    return sampling.weighted_sample(i("v_profile"), 12_000, "nb", "id", 8).select("id", "icd10_raw", "nb")


@query(f"SELECT id, icd10_raw FROM v_profile ORDER BY {HASH.format("'42|' || id")}, id LIMIT 5")
def seeded_sample(i: Inputs) -> DataFrame:
    return sampling.seeded_sample(i("v_profile"), 5, "id", 42).select("id", "icd10_raw")


@query(f"""SELECT code_racine, code_postcoord FROM (SELECT *, row_number() OVER (PARTITION BY code_racine
      ORDER BY {HASH.format("'3|' || code_racine || '|' || code_postcoord")}, code_postcoord) AS rn
    FROM (SELECT DISTINCT code_racine, code_postcoord FROM v_pc)) WHERE rn <= 5""")
def draw_per_root(i: Inputs) -> DataFrame:
    return sampling.draw_per_key(i("v_pc"), ["code_racine"], "code_postcoord", 5, 3)


def drawn_sql(name: str, keyed: str, k: int, seed: int = 5) -> str:
    """SQL of ``draw_for_rows`` for the rows (id, code_racine) of ``keyed``: distinct positions slot by slot; a number met before
    gives way to the last one allowed."""
    spots = f"SELECT id, code_racine, n, CAST([] AS BIGINT[]) AS taken FROM {keyed} JOIN (SELECT DISTINCT code_racine, n FROM {name}_ranked) USING (code_racine)"
    for slot in range(k):
        last = f"(n - {k - 1 - slot})"
        number = f"({HASH.format(f"'{seed}|' || id || '|{slot}'")} % greatest({last}, 1) + 1)"
        spots = f"""SELECT id, code_racine, n, CASE WHEN {last} < 1 THEN taken WHEN list_contains(taken, {number}) THEN list_append(taken, {last})
            ELSE list_append(taken, {number}) END AS taken FROM ({spots})"""
    return f"""{name}_ranked AS (SELECT code_racine, code_postcoord, row_number() OVER (PARTITION BY code_racine
      ORDER BY {HASH.format(f"'{seed}|' || code_racine || '|' || code_postcoord")}, code_postcoord) AS pos,
      count(*) OVER (PARTITION BY code_racine) AS n
    FROM (SELECT DISTINCT code_racine, code_postcoord FROM v_pc)),
  {name} AS (SELECT s.id, s.code_racine, r.code_postcoord FROM (SELECT id, code_racine, unnest(taken) AS pos FROM ({spots})) s
    JOIN {name}_ranked r ON r.code_racine = s.code_racine AND r.pos = s.pos)"""


DRAWN = drawn_sql("drawn", "keyed", 5)


@query(f"""WITH keyed AS (SELECT id_crh AS id, min(code_cim11) AS code_racine FROM v_diag GROUP BY 1), {DRAWN}
    SELECT id, code_racine, code_postcoord FROM drawn""")
def draw_per_report(i: Inputs) -> DataFrame:
    keyed = i("v_diag").groupBy("id_crh").agg({"code_cim11": "min"}).toDF("id", "code_racine")
    return sampling.draw_for_rows(keyed, "id", "code_racine", i("v_pc"), "code_postcoord", 5, 5)
