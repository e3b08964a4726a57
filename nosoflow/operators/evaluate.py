"""Evaluation: case selection, code and label agreement, precision and recall."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nosoflow.functions.codes import root_code
from nosoflow.functions.text import label_matches, strip
from nosoflow.operators.scaling import concat_all, lookup_join


def evaluation_set(
    reports: DataFrame, diagnostics: DataFrame, codes: DataFrame, limit: int, shortest: int = 2500, longest: int = 9000
) -> DataFrame:
    """The ``limit`` shortest cases of ``case_table`` with their texts. The choice runs on ids and lengths only."""
    cases = case_table(reports, diagnostics, codes, shortest, longest).orderBy("longueur", "id_crh", "code_dp").limit(limit)
    return lookup_join(reports.select("id_crh", "texte_crh"), cases, "id_crh", "inner").select(
        "id_crh", "texte_crh", "code_dp", "libelle_dp", "longueur")


def case_table(reports: DataFrame, diagnostics: DataFrame, codes: DataFrame, shortest: int = 2500, longest: int = 9000) -> DataFrame:
    """One report per main-diagnosis code, the one of smallest id with a length within bounds. Texts are not carried."""
    sized = reports.select("id_crh", F.length("texte_crh").alias("longueur")).where(F.col("longueur").between(shortest, longest))
    main = diagnostics.where(F.col("type_diag") == "DP").select("id_crh", F.col("code_cim11").alias("code_dp")).distinct()
    eligible = lookup_join(main, sized, "id_crh", "inner")
    chosen = eligible.groupBy("code_dp").agg(F.min(F.struct("id_crh", "longueur")).alias("c")).select("code_dp", "c.*")
    return chosen.join(codes.select(F.col("code").alias("code_dp"), F.col("libelle").alias("libelle_dp")), "code_dp", "left")


def agreement(cases: DataFrame) -> DataFrame:
    """Per case: answered, same code, same root, same label.

    ``cases`` has ``code_dp``, ``libelle_dp``, ``code_predit``, ``libelle_predit``; a null ``code_predit`` is a missing answer.
    """
    answered = F.col("code_predit").isNotNull()

    def flag(test: Column) -> Column:
        return answered & F.coalesce(test, F.lit(False))

    return cases.withColumns({
        "repondu": answered,
        "exact": flag(F.upper(strip(F.col("code_predit"))) == F.upper(strip(F.col("code_dp")))),
        "souple": flag(root_code(F.col("code_predit")) == root_code(F.col("code_dp"))),
        "meme_libelle": flag(label_matches(F.col("libelle_predit"), F.col("libelle_dp"))),
    })


def agreement_counts(judged: DataFrame) -> DataFrame:
    return judged.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c)).alias(f"n_{c}") for c in ("repondu", "exact", "souple", "meme_libelle")])


def code_metrics(expected: DataFrame, predicted: Mapping[str, DataFrame]) -> DataFrame:
    """Precision, recall, F1 and exact match of several predictions over (``id``, ``code``) tables, strict and lenient.

    Codes are compared as sets per report, whole (``strict``) or by root (``souple``); precision and recall are summed over all reports. Exact match is the
    share of reports, of those with a code on either side, whose two sets are equal. All sets are stacked with a mark and read once; sets are
    grouped by code, by root and by report, never gathered into lists. Columns ``variante``, ``mode``, ``metrique``, ``valeur``.
    """
    names = list(predicted)
    stacked = concat_all([
        df.select("id", F.upper(strip(F.col("code"))).alias("code"), root_code(F.col("code")).alias("racine"), F.lit(n).alias("_side"))
        for n, df in enumerate([expected, *predicted.values()])])

    def flag(n: int) -> Column:
        return F.max((F.col("_side") == n).cast("int")).alias(f"_f{n}")

    flags = [f"_f{n}" for n in range(len(names) + 1)]
    by_code = stacked.groupBy("id", "racine", "code").agg(*[flag(n) for n in range(len(flags))])
    by_root = by_code.groupBy("id", "racine").agg(
        *[F.max(f).alias(f) for f in flags], *[F.sum(f).alias(f"_s{f}") for f in flags],
        *[F.sum(F.col("_f0") * F.col(f)).alias(f"_b{f}") for f in flags[1:]])

    def sums(mode: str, name: str, f: str) -> list[Column]:
        own = [F.sum("_s_f0"), F.sum(f"_s{f}"), F.sum(f"_b{f}")] if mode == "strict" else [F.sum("_f0"), F.sum(f), F.sum(F.col("_f0") * F.col(f))]
        return [c.alias(f"{what}_{mode}_{name}") for what, c in zip(("ne", "np", "both"), own)]

    kinds = [(mode, name, f) for mode in ("strict", "souple") for name, f in zip(names, flags[1:])]
    per_report = by_root.groupBy("id").agg(*[c for kind in kinds for c in sums(*kind)])
    cells = F.array(*[F.struct(
        F.lit(name).alias("variante"), F.lit(mode).alias("mode"), *[F.col(f"{what}_{mode}_{name}").alias(what) for what in ("ne", "np", "both")])
        for mode, name, _ in kinds])
    rows = per_report.select(F.explode(cells).alias("c")).select("c.*")
    present = (F.col("ne") > 0) | (F.col("np") > 0)
    totals = rows.groupBy("variante", "mode").agg(
        F.sum("both").alias("both"), F.sum("ne").alias("ne"), F.sum("np").alias("np"), F.count_if(present).alias("n"),
        F.count_if(present & (F.col("ne") == F.col("both")) & (F.col("np") == F.col("both"))).alias("same"))
    zero = F.lit(0)
    values = {
        "precision": F.col("both") / F.nullif(F.col("np"), zero), "recall": F.col("both") / F.nullif(F.col("ne"), zero),
        "f1": F.lit(2.0) * F.col("both") / F.nullif(F.col("np") + F.col("ne"), zero), "exact_match": F.col("same") / F.nullif(F.col("n"), zero)}
    cells = F.array(*[F.struct(F.lit(name).alias("metrique"), F.round(value, 4).alias("valeur")) for name, value in values.items()])
    return totals.select("variante", "mode", F.explode(cells).alias("m")).select("variante", "mode", "m.metrique", "m.valeur")
