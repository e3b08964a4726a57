"""Evaluation set, agreement with the reference codes, label keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nosoflow.functions.replies import main_diagnosis
from nosoflow.functions.text import normalize_label
from nosoflow.operators import evaluate
from nosoflow.operators.scaling import lookup_join
from nosoflow.operators.scoring import score_reports
from nosoflow.plans.registry import query
from nosoflow.plans.terminology import CODES, codes
from nosoflow.plans.views import Inputs

CASES = """cases AS (SELECT e.code_dp, e.id_crh, length(c.texte_crh) AS longueur, c.texte_crh, k.libelle AS libelle_dp FROM (
      SELECT d.code_cim11 AS code_dp, min(d.id_crh) AS id_crh FROM v_diag d JOIN v_crh c ON c.id_crh = d.id_crh
      WHERE d.type_diag = 'DP' AND length(c.texte_crh) BETWEEN 2500 AND 9000 GROUP BY 1) e
    JOIN v_crh c ON c.id_crh = e.id_crh LEFT JOIN codes k ON k.code = e.code_dp
    {limit})"""
FOLD = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH {CODES}, {CASES.format(limit="ORDER BY longueur, id_crh, code_dp LIMIT 200")} SELECT id_crh, md5(texte_crh) AS texte, code_dp, libelle_dp, longueur FROM cases")
def evaluation_set(i: Inputs) -> DataFrame:
    cases = evaluate.evaluation_set(i("v_crh"), i("v_diag"), codes(i), 200)
    return cases.select("id_crh", F.md5("texte_crh").alias("texte"), "code_dp", "libelle_dp", F.col("longueur").cast("bigint").alias("longueur"))


PART = r"[A-Z0-9]{2,10}(?:\.[A-Z0-9]+)?"
LABELLED = r"([^(]+?)\s*\((" + PART + "(?:&" + PART + r")*)\)"
JUDGED = f"""answer AS (SELECT id_crh, nullif(regexp_extract(t, '{LABELLED}', 2), '') AS code_predit, trim(regexp_extract(t, '{LABELLED}', 1)) AS libelle_predit
    FROM (SELECT id_crh, CASE WHEN contains(reply, 'DP :') THEN split_part(split_part(reply, 'DAS :', 1), 'DP :', 2) ELSE reply END AS t FROM v_answer)),
  judged AS (SELECT c.*, a.code_predit, a.code_predit IS NOT NULL AS repondu, coalesce(upper(a.code_predit) = upper(c.code_dp), false) AS exact,
    coalesce(split_part(upper(a.code_predit), '&', 1) = upper(c.code_dp), false) AS souple,
    coalesce(a.code_predit IS NOT NULL AND coalesce(c.libelle_dp, '') <> '' AND contains({FOLD.format('a.libelle_predit')}, {FOLD.format('c.libelle_dp')}), false) AS meme_libelle
    FROM cases c LEFT JOIN answer a ON a.id_crh = c.id_crh)"""


def judged(i: Inputs) -> DataFrame:
    cases = evaluate.case_table(i("v_crh"), i("v_diag"), codes(i))
    main = main_diagnosis(F.col("reply"))
    answers = i("v_answer").select("id_crh", main.alias("m")).select(
        "id_crh", F.col("m.code").alias("code_predit"), F.col("m.libelle").alias("libelle_predit"))
    return evaluate.agreement(lookup_join(cases, answers, "id_crh", "left"))


@query(f"WITH {CODES}, {CASES.format(limit="")}, {JUDGED} SELECT id_crh, code_dp, code_predit, repondu, exact, souple, meme_libelle FROM judged")
def judged_cases(i: Inputs) -> DataFrame:
    return judged(i).select("id_crh", "code_dp", "code_predit", "repondu", "exact", "souple", "meme_libelle")


@query(f"""WITH {CODES}, {CASES.format(limit="")}, {JUDGED} SELECT count(*) AS n, count(*) FILTER (repondu) AS n_repondu, count(*) FILTER (exact) AS n_exact,
    count(*) FILTER (souple) AS n_souple, count(*) FILTER (meme_libelle) AS n_meme_libelle FROM judged""")
def evaluate_codes(i: Inputs) -> DataFrame:
    return evaluate.agreement_counts(judged(i))


@query(f"SELECT id_crh, md5({FOLD.format('texte_crh')}) AS cle FROM v_crh")
def label_keys(i: Inputs) -> DataFrame:
    return i.spread("v_crh").select("id_crh", F.md5(normalize_label(F.col("texte_crh"))).alias("cle"))


@query("""SELECT id, upper(trim(split_part(code, '&', 1))) AS racine, count(*) AS n FROM v_codes_fine GROUP BY 1, 2""")
def root_counts(i: Inputs) -> DataFrame:
    from nosoflow.functions.codes import root_code

    return i("v_codes_fine").groupBy("id", root_code(F.col("code")).alias("racine")).agg(F.count(F.lit(1)).alias("n"))


def _stub():
    """Scorer that codes a report by its length and refuses some; stands in for a model."""

    def reply(text: str) -> str:
        if len(text) % 97 == 5:
            raise ValueError("texte refusé")
        second = "aucun" if len(text) % 3 else f"suite (5B{len(text) % 10}Z)"
        return f"DP : rapport (AA{len(text) % 100:02d})\nDAS : {second}"

    return lambda texts: texts.map(reply)


@query("""SELECT id_crh, CASE WHEN n % 97 <> 5 THEN 'AA' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') END AS code,
      CASE WHEN n % 97 <> 5 THEN CAST(n % 3 = 0 AS INTEGER) END AS n_das, CASE WHEN n % 97 = 5 THEN 'texte refusé' END AS erreur, 'stub' AS modele
    FROM (SELECT id_crh, length(texte_crh) AS n FROM v_crh)""")
def scored_reports(i: Inputs) -> DataFrame:
    scored = score_reports(i.spread("v_crh"), "id_crh", "texte_crh", _stub, "stub")
    return scored.select("id_crh", F.col("dp.code").alias("code"), F.when(F.col("erreur").isNull(), F.size("das")).alias("n_das"), "erreur", "modele")
