"""Terminology load, dictionary, search and extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nosoflow.operators import quality, relational, textindex
from nosoflow.operators import terminology as t
from nosoflow.operators.scaling import cut_lineage, lookup_join, work_folder
from nosoflow.plans.registry import query
from nosoflow.plans.views import Inputs

ORD = ["ord1", "ord2", "ord3", "ord4", "ord5"]

# First row per code, shared by the oracles below.
CODES = """codes AS (SELECT code, texte AS libelle, type, ord FROM (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY ord) AS rn FROM v_term) WHERE rn = 1)"""
HALF = "half AS (SELECT code, libelle, type FROM codes ORDER BY ord LIMIT 700)"
MAP = """icd AS (SELECT icd10, icd11 FROM (
  SELECT *, row_number() OVER (PARTITION BY icd10 ORDER BY ord DESC) AS rn FROM v_map10) WHERE rn = 1)"""
SYN = """syn AS (SELECT s.*, m.icd11 AS code_cim11 FROM v_syn s LEFT JOIN (
  SELECT * FROM icd WHERE icd11 IN (SELECT code FROM codes)) m ON m.icd10 = s.code)"""


def codes(i: Inputs, limit: int = 0) -> DataFrame:
    return t.load_codes(i("v_term"), ["ord"], limit)


def synonyms(i: Inputs, limit: int = 0) -> DataFrame:
    return t.load_synonyms(i("v_syn"), t.icd_map(i("v_map10"), ["ord"]), codes(i), ORD, limit)


@query("""
    WITH codes AS (SELECT code, min(texte) AS libelle FROM (
        SELECT code, first_value(texte) OVER (PARTITION BY code ORDER BY ord) AS texte FROM v_term) GROUP BY code),
      icd AS (SELECT icd10, max_by(icd11, ord) AS icd11 FROM v_map10 GROUP BY icd10),
      syn AS (SELECT m.icd11 AS code, count(*) AS n FROM v_syn s JOIN icd m ON m.icd10 = s.code GROUP BY 1),
      pc AS (SELECT code_racine AS code, count(DISTINCT code_postcoord) AS n FROM v_pc GROUP BY 1),
      dp AS (SELECT d.code_cim11 AS code, min(r.texte_crh) AS texte FROM v_diag d JOIN v_crh r ON r.id_crh = d.id_crh WHERE type_diag = 'DP' GROUP BY 1)
    SELECT c.code AS code_cim11, c.libelle, syn.n AS nb_synonymes, pc.n AS nb_postcoord, dp.texte AS exemple_crh
    FROM codes c JOIN dp USING (code) JOIN syn USING (code) JOIN pc USING (code) ORDER BY nb_postcoord DESC, code_cim11 LIMIT 50""")
def well_documented_codes(i: Inputs) -> DataFrame:
    loaded = codes(i)
    syn = t.load_synonyms(i("v_syn"), t.icd_map(i("v_map10"), ["ord"]), loaded, ORD)
    return t.well_documented_codes(loaded, i("v_diag"), i("v_crh"), syn, i("v_pc"), 50)


@query("""SELECT code_racine, count(*) AS nb_combinaisons_realistes FROM v_pc
    GROUP BY code_racine ORDER BY 2 DESC, 1 LIMIT 20""")
def top_postcoord_roots(i: Inputs) -> DataFrame:
    return t.top_roots(i("v_pc"), 20)


@query("""SELECT 'code_cim11' AS table_name, count(*) AS n_rows FROM (SELECT DISTINCT code FROM v_term)
    UNION ALL SELECT 'crh', count(*) FROM v_crh UNION ALL SELECT 'diagnostic', count(*) FROM v_diag
    UNION ALL SELECT 'synonyme', count(*) FROM v_syn UNION ALL SELECT 'code_postcoord', count(*) FROM v_pc
    UNION ALL SELECT 'axe_postcoord', count(*) FROM v_axis_csv""")
def table_counts(i: Inputs) -> DataFrame:
    return relational.table_counts({
        "code_cim11": i("v_term").select("code").distinct(), "crh": i("v_crh"), "diagnostic": i("v_diag"),
        "synonyme": i("v_syn"), "code_postcoord": i("v_pc"), "axe_postcoord": i("v_axis_csv")})


@query("""SELECT n_codes, n_crh, n_codes > 1000 AND n_crh >= 1 AS valide FROM
    (SELECT (SELECT count(DISTINCT code) FROM v_term) AS n_codes, (SELECT count(*) FROM v_crh) AS n_crh)""")
def volume_check(i: Inputs) -> DataFrame:
    return quality.volume_check(codes(i), i("v_crh"))


@query(f"WITH {CODES} SELECT code, libelle, type FROM codes WHERE libelle ILIKE '%R_d%' ORDER BY code LIMIT 50 OFFSET 10")
def code_search(i: Inputs) -> DataFrame:
    return relational.page(relational.search(codes(i), "libelle", "R_d"), ["code"], 50, 10)


@query(f"WITH {CODES} SELECT code, libelle, type FROM codes WHERE libelle ILIKE '%blu% ro%'")
def indexed_code_search(i: Inputs) -> DataFrame:
    """All matches, by the index of the labels' trigrams."""
    loaded, path = cut_lineage(codes(i)), work_folder(i.spark, "index")
    textindex.build(loaded, "code", "libelle", path)
    return textindex.indexed_search(loaded, "code", "libelle", "blu% ro", path)


@query(f"WITH {CODES} SELECT code, libelle, type FROM codes ORDER BY code LIMIT 100 OFFSET 20")
def code_page(i: Inputs) -> DataFrame:
    return relational.page(relational.search(codes(i), "libelle", None), ["code"], 100, 20)


@query(f"""
    WITH {CODES}, {MAP}, {SYN},
      wanted AS (SELECT code FROM v_term WHERE ord = 12 UNION ALL SELECT 'INCONNU'),
      child AS (SELECT code_cim11 AS code, 'synonyme' AS genre, synonyme AS valeur FROM syn WHERE code_cim11 IS NOT NULL
        UNION ALL SELECT code_racine, 'postcoordination', min(code_postcoord) FROM v_pc GROUP BY code_racine, code_postcoord)
    SELECT w.code, c.libelle, c.type, c.code IS NOT NULL AS trouve, k.genre, k.valeur
    FROM wanted w LEFT JOIN codes c ON c.code = w.code LEFT JOIN child k ON k.code = w.code""")
def code_detail(i: Inputs) -> DataFrame:
    wanted = i("v_term").where(F.col("ord") == 12).select("code")
    unknown = wanted.select(F.lit("INCONNU").alias("code"))
    wanted = cut_lineage(wanted.unionByName(unknown))
    # terms, mapping and child tables are cut down to the wanted codes before anything is ordered or joined
    loaded = cut_lineage(t.load_codes(lookup_join(i("v_term"), wanted, "code", "left_semi"), ["ord"]))
    mapping = t.icd_map(t.mapping_of(i("v_map10"), loaded), ["ord"])
    return t.code_detail(wanted, loaded, t.load_synonyms(i("v_syn"), mapping, loaded, ORD), t.load_postcoord(i("v_pc"), loaded, ORD))


@query(f"WITH {CODES} SELECT code, libelle, type FROM codes")
def load_terms(i: Inputs) -> DataFrame:
    return codes(i)


@query(f"WITH {CODES}, {HALF} SELECT * FROM half")
def load_terms_limited(i: Inputs) -> DataFrame:
    return codes(i, 700)


@query(f"WITH {CODES}, {MAP}, {SYN} SELECT {', '.join(ORD)}, code_cim11, synonyme, source FROM syn WHERE code_cim11 IS NOT NULL")
def load_synonyms(i: Inputs) -> DataFrame:
    return synonyms(i)


@query(f"""
    WITH {CODES}, {MAP}, {SYN},
      seq AS (SELECT code_cim11 IS NOT NULL AS ok, row_number() OVER w AS n,
        count(code_cim11) OVER w AS kept FROM syn WINDOW w AS (ORDER BY ord1, ord2, ord3, ord4, ord5 ROWS UNBOUNDED PRECEDING)),
      stop AS (SELECT min(n) AS n FROM seq WHERE kept = 1000)
    SELECT count(*) FILTER (ok) AS n_charges, count(*) FILTER (NOT ok) AS n_non_mappes
    FROM seq WHERE n <= (SELECT coalesce(n, 9223372036854775807) FROM stop)""")
def synonym_load_counts(i: Inputs) -> DataFrame:
    return t.synonym_load_counts(i("v_syn"), t.icd_map(i("v_map10"), ["ord"]), codes(i), ORD, 1000)


@query(f"""
    WITH {CODES}
    SELECT code_postcoord, code_racine, libelles_extensions FROM (
      SELECT *, row_number() OVER (PARTITION BY code_postcoord ORDER BY ord1, ord2, ord3, ord4, ord5) AS rn
      FROM v_pc WHERE code_racine IN (SELECT code FROM codes)) WHERE rn = 1""")
def load_postcoord(i: Inputs) -> DataFrame:
    return t.load_postcoord(i("v_pc"), codes(i), ORD)


@query(f"""
    WITH {CODES}
    SELECT code AS code_cim11, axe_nom, allow_multiple, CAST(nullif(taille_axe, '') AS INTEGER) AS taille_axe,
      nullif(raison_arret, '') AS raison_arret
    FROM v_axis_csv WHERE code IN (SELECT code FROM codes)""")
def load_axes(i: Inputs) -> DataFrame:
    return t.load_axes(i("v_axis_csv"), codes(i), ["ord"])


DICTIONARY = """dico AS (
  SELECT synonyme, min_by(code, k) AS code, string_agg(source, ' / ' ORDER BY k) AS source FROM (
    SELECT synonyme, source, min(k) AS k, min_by(code, k) AS code FROM (
      SELECT *, row_number() OVER (ORDER BY ord1, ord2, ord3, ord4, ord5) AS k FROM v_syn WHERE code IS NOT NULL)
    GROUP BY synonyme, source) GROUP BY synonyme)"""


@query(f"WITH {DICTIONARY} SELECT code, synonyme, source FROM dico WHERE NOT starts_with(code, 'Z')")
def synonym_dictionary(i: Inputs) -> DataFrame:
    return t.without_chapter(t.synonym_dictionary(i("v_syn"), ORD)).select("code", "synonyme", "source")


@query(f"WITH {DICTIONARY} SELECT source, count(*) AS n FROM dico GROUP BY source")
def source_combinations(i: Inputs) -> DataFrame:
    return relational.count_by(t.synonym_dictionary(i("v_syn"), ORD), ["source"]).orderBy(F.desc("n"), "source")


@query(f"""WITH {DICTIONARY} SELECT count(*) AS nb_synonymes, count(DISTINCT code) AS nb_codes FROM dico
    WHERE NOT starts_with(code, 'Z')""")
def synonym_summary(i: Inputs) -> DataFrame:
    kept = t.without_chapter(t.synonym_dictionary(i("v_syn"), ORD))
    return kept.agg(F.count(F.lit(1)).alias("nb_synonymes"), F.count_distinct("code").alias("nb_codes"))


@query("SELECT DISTINCT code, texte AS libelle FROM v_term WHERE type = 'title' ORDER BY code")
def title_codes(i: Inputs) -> DataFrame:
    titles = relational.official_titles(i("v_term"), ["code", "texte"])
    return relational.rename(titles, {"texte": "libelle"}).orderBy("code")


@query("""SELECT l_suppkey AS ord4, source_part AS source, count(*) AS n FROM (
    SELECT l_suppkey, 'a' AS source_part FROM lineitem WHERE l_linenumber = 1
    UNION ALL SELECT l_suppkey, 'b' FROM lineitem WHERE l_linenumber > 1) GROUP BY 1, 2""")
def tagged_parts(i: Inputs) -> DataFrame:
    from nosoflow.sources.readers import union_parts

    rows = i("v_syn")
    parts = {"a": rows.where("ord2 = 1").drop("source"), "b": rows.where("ord2 > 1").drop("source")}
    return relational.count_by(union_parts(parts, ["ord4"]), ["ord4", "source"])
