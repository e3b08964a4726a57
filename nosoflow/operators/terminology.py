"""Terminology tables: codes, synonyms, post-coordinated codes, axes, and extracts over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nosoflow.operators.relational import drop_codes, first_per_key, keep_last_map, load_limit, page, page_after, top_counts
from nosoflow.operators.scaling import cut_lineage, lookup_join
from nosoflow.operators.selection import first_rows


DETAIL = ("code", "libelle", "type", "trouve", "genre", "valeur")


def load_codes(terms: DataFrame, order: Sequence[str], limit: int = 0) -> DataFrame:
    """Code table: the first term row of each code, at most ``limit`` accepted rows."""
    kept = first_per_key(terms, ["code"], order)
    return load_limit(kept, order, limit).select("code", F.col("texte").alias("libelle"), "type")


def icd_map(mapping: DataFrame, order: Sequence[str]) -> DataFrame:
    """ICD-10 to ICD-11 dictionary; the last row of a key wins. Columns ``icd10``, ``icd11``."""
    kept = keep_last_map(mapping, F.col("icd10"), F.col("icd11"), order)
    return kept.select(F.col("key").alias("icd10"), F.col("value").alias("icd11"))


def mapping_of(mapping: DataFrame, codes: DataFrame) -> DataFrame:
    """All rows of the ICD-10 keys that lead to one of ``codes`` in some row, so that the last row of a key can still be told."""
    keys = lookup_join(mapping.select("icd10", F.col("icd11").alias("code")), codes.select("code"), "code", "left_semi").select("icd10").distinct()
    return lookup_join(mapping, keys, "icd10", "left_semi")


def _mapped_synonyms(synonyms: DataFrame, mapping: DataFrame, codes: DataFrame) -> DataFrame:
    """Synonym rows with ``code_cim11``, null when unmapped or outside the terminology."""
    valid = lookup_join(mapping, codes.select(F.col("code").alias("icd11")), "icd11", "left_semi")
    target = valid.select(F.col("icd10").alias("code"), F.col("icd11").alias("code_cim11"))
    return lookup_join(synonyms, target, "code", "left")


def load_synonyms(
    synonyms: DataFrame, mapping: DataFrame, codes: DataFrame, order: Sequence[str], limit: int = 0
) -> DataFrame:
    """Synonyms whose exact ICD-10 code maps to a loaded code."""
    accepted = _mapped_synonyms(synonyms, mapping, codes).where(F.col("code_cim11").isNotNull())
    return load_limit(accepted, order, limit).select(*order, "code_cim11", "synonyme", "source")


def synonym_load_counts(
    synonyms: DataFrame, mapping: DataFrame, codes: DataFrame, order: Sequence[str], limit: int = 0
) -> DataFrame:
    """Loaded and unmapped rows; reading stops, and so does counting, at the last accepted row."""
    rows = _mapped_synonyms(synonyms, mapping, codes).select("code_cim11", F.struct(*order).alias("ord"))
    accepted = F.col("code_cim11").isNotNull()
    if limit:
        kept = first_rows(rows.where(accepted), ["ord"], limit)
        stop = kept.agg(F.when(F.count(F.lit(1)) == limit, F.max("ord")).alias("stop"))
        rows = rows.withColumn("_stop", stop.scalar()).where(F.col("_stop").isNull() | (F.col("ord") <= F.col("_stop")))
    return rows.agg(F.count_if(accepted).alias("n_charges"), F.count_if(~accepted).alias("n_non_mappes"))


def load_postcoord(postcoord: DataFrame, codes: DataFrame, order: Sequence[str], limit: int = 0) -> DataFrame:
    """Post-coordinated codes of loaded roots, the first row of each code."""
    valid = lookup_join(postcoord, codes.select(F.col("code").alias("code_racine")), "code_racine", "left_semi")
    kept = load_limit(first_per_key(valid, ["code_postcoord"], order), order, limit)
    return kept.select("code_postcoord", "code_racine", "libelles_extensions")


def load_axes(axes: DataFrame, codes: DataFrame, order: Sequence[str], limit: int = 0) -> DataFrame:
    """Axes of loaded codes; empty size and stop reason become null."""
    valid = lookup_join(axes, codes.select("code"), "code", "left_semi")
    return load_limit(valid, order, limit).select(
        F.col("code").alias("code_cim11"),
        "axe_nom",
        "allow_multiple",
        F.nullif(F.col("taille_axe"), F.lit("")).cast("int").alias("taille_axe"),
        F.nullif(F.col("raison_arret"), F.lit("")).alias("raison_arret"),
    )


def synonym_dictionary(sources: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per synonym: first code, and distinct sources in order of appearance joined by `` / ``.

    Rows are first reduced to one per (synonym, source), so the list built per
    synonym holds source names only, however often a synonym is repeated.
    """
    rows = sources.dropna(subset=["code", "synonyme"]).withColumn("ord", F.struct(*order))
    per_source = rows.groupBy("synonyme", "source").agg(F.min("ord").alias("ord"), F.min_by("code", "ord").alias("code"))
    seen = F.array_sort(F.collect_list(F.struct("ord", "source")))
    return per_source.groupBy("synonyme").agg(
        F.min_by("code", "ord").alias("code"),
        F.array_join(F.transform(seen, lambda s: s["source"]), " / ").alias("source"),
    )


def without_chapter(dictionary: DataFrame, prefix: str = "Z") -> DataFrame:
    return drop_codes(dictionary, "code", prefix=prefix)


def top_roots(postcoord: DataFrame, top: int = 20) -> DataFrame:
    """Roots with the most post-coordinated rows."""
    return top_counts(postcoord, "code_racine", top, "nb_combinaisons_realistes")


def well_documented_codes(
    codes: DataFrame, diagnostics: DataFrame, reports: DataFrame, synonyms: DataFrame, postcoord: DataFrame, limit: int = 50
) -> DataFrame:
    """Codes that are a main diagnosis and have synonyms and post-coordinated codes.

    Every side is reduced to one row per code before joining, so synonyms are never
    multiplied by post-coordinated codes and reports. Texts are joined last, to the reports
    of the ranked codes only.
    """
    n_syn = synonyms.groupBy("code_cim11").agg(F.count(F.lit(1)).alias("nb_synonymes"))
    n_pc = postcoord.groupBy(F.col("code_racine").alias("code_cim11")).agg(
        F.count_distinct("code_postcoord").alias("nb_postcoord"))
    main = diagnostics.where(F.col("type_diag") == "DP").select("code_cim11", "id_crh").distinct()
    with_report = lookup_join(main, reports.select("id_crh"), "id_crh", "left_semi")
    ranked = (
        codes.select(F.col("code").alias("code_cim11"), "libelle")
        .join(with_report.select("code_cim11").distinct(), "code_cim11", "left_semi")
        .join(n_syn, "code_cim11")
        .join(n_pc, "code_cim11")
        .orderBy(F.desc("nb_postcoord"), "code_cim11")
        .limit(limit)
    )
    ranked = cut_lineage(ranked)  # few rows, counted once; the texts are fetched for them only
    wanted = lookup_join(with_report, ranked.select("code_cim11"), "code_cim11", "left_semi")
    example = (
        lookup_join(wanted, reports.select("id_crh", "texte_crh"), "id_crh", "inner")
        .groupBy("code_cim11").agg(F.min("texte_crh").alias("exemple_crh"))
    )
    return ranked.join(example, "code_cim11").select(
        "code_cim11", "libelle", "nb_synonymes", "nb_postcoord", "exemple_crh")


def code_detail(wanted: DataFrame, codes: DataFrame, synonyms: DataFrame, postcoord: DataFrame) -> DataFrame:
    """Requested codes with both child lists, one row per child.

    ``wanted`` has a ``code`` column. The two lists are stacked, not joined, so they
    never multiply; a code without children keeps one row with null child, and an
    unknown code one row with ``trouve`` false.
    """
    found = lookup_join(wanted, codes, "code", "left").withColumn("trouve", F.col("libelle").isNotNull())
    syn = synonyms.select(F.col("code_cim11").alias("code"), F.lit("synonyme").alias("genre"), F.col("synonyme").alias("valeur"))
    pc = postcoord.select(
        F.col("code_racine").alias("code"), F.lit("postcoordination").alias("genre"), F.col("code_postcoord").alias("valeur"))
    # the requested codes are the lookup side: a handful of rows, checked before broadcasting
    children = lookup_join(syn.unionByName(pc), found, "code", "inner")
    alone = found.join(children.select("code").distinct(), "code", "left_anti")
    none = F.lit(None).cast("string")
    return children.select(*DETAIL).unionByName(alone.select(*DETAIL[:4], none.alias("genre"), none.alias("valeur")))


def reports_page(
    reports: DataFrame, diagnostics: DataFrame, order: Sequence[str], limit: int = 20, offset: int = 0, cap: int = 200, after=None
) -> DataFrame:
    """One page of reports with their diagnoses, one row per diagnosis.

    The limit counts reports: it is applied before the join. A report without
    diagnosis keeps one row. The page (at most ``cap`` rows) is the broadcast side. ``offset`` is bounded as in ``page``; deeper pages start ``after`` the
    last report of the page before, at the same cost at any depth.
    """
    if after is None:
        parents = cut_lineage(page(reports, ["id_crh"], limit, offset, cap))
    else:
        parents = cut_lineage(page_after(reports, "id_crh", after, limit, cap))
    columns = ["type_diag", "code_cim11", *order]
    children = diagnostics.select("id_crh", *columns).join(F.broadcast(parents), "id_crh")
    alone = parents.join(children.select("id_crh").distinct(), "id_crh", "left_anti")
    kinds = dict(diagnostics.dtypes)
    missing = [F.lit(None).cast(kinds[c]).alias(c) for c in columns]
    return children.select(*parents.columns, *columns).unionByName(alone.select(*parents.columns, *missing))
