"""Corpus rules, constraints, erasure, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nosoflow.operators import evaluate, quality, relational, reports, terminology
from nosoflow.operators.scaling import concat_all, lookup_join
from nosoflow.plans.registry import query
from nosoflow.plans.reports import PARSED
from nosoflow.plans.terminology import ORD
from nosoflow.plans.views import Inputs

def corpus(i: Inputs) -> DataFrame:
    """Raw lines: one per conversation, then one per coded reply; some malformed, some blank.

    Conversations have even numbers, replies odd ones. Only those of three turns can be examples, so only for them a list is built; the line of any
    other has one message that tells its number of turns.
    """
    counts = i("v_message").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    turns = lookup_join(i("v_message"), counts.where("n = 3").select("conv_id"), "conv_id", "left_semi")
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))),
                           lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    chats = turns.groupBy("conv_id").agg(messages.alias("messages"))
    told = F.array(F.struct(F.concat(F.col("n").cast("string"), F.lit(" tours")).alias("role"), F.lit("").alias("content")))
    chats = chats.unionByName(counts.where("n <> 3").select("conv_id", told.alias("messages")))
    chats = chats.select((F.col("conv_id") * 2).alias("num"), "messages")
    text = F.when(F.col("id") % 50 == 0, F.lit("  court ")).otherwise(
        F.concat(F.lit("Compte rendu "), (F.col("id") % 400).cast("string")))

    def message(role: str, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    made = F.array(message("system", F.lit("consigne")), message("user", text), message("assistant", F.col("reply")))
    samples = i("v_reply").select((F.col("id") * 2 + 1).alias("num"), made.alias("messages"))
    line = F.to_json(F.struct("messages"))
    broken = (
        F.when(F.col("num") % 17 == 3, F.substring(line, 1, 20))
        .when(F.col("num") % 17 == 4, F.replace(line, F.lit('"messages"'), F.lit('"autre"')))
        .when(F.col("num") % 101 == 5, F.lit("   ")).otherwise(line))
    return chats.unionByName(samples).select("num", broken.alias("brut"))


CORPUS = f"""{PARSED}, three AS (SELECT conv_id * 2 AS num, string_agg(role, ',' ORDER BY turn) AS roles,
      max(content) FILTER (role = 'user') AS u, max(content) FILTER (role = 'assistant') AS a FROM v_message GROUP BY conv_id),
  all_lines AS (SELECT num, roles, u, regexp_matches(CASE WHEN contains(a, 'DP :') THEN substr(a, instr(a, 'DP :') + 4) ELSE a END,
      '\\([A-Z0-9]{{2,10}}(\\.[A-Z0-9]+)?(&[A-Z0-9]{{2,10}}(\\.[A-Z0-9]+)?)*\\)') AS dp FROM three
    UNION ALL SELECT m.id * 2 + 1, 'system,user,assistant', CASE WHEN m.id % 50 = 0 THEN '  court ' ELSE 'Compte rendu ' || (m.id % 400) END,
      m.id IN (SELECT id FROM diag WHERE type_diag = 'DP') FROM main m),
  lines AS (SELECT * FROM all_lines WHERE num % 17 IN (3, 4) OR num % 101 <> 5),
  good AS (SELECT num, trim(u, ' ' || chr(10)) AS u, dp FROM lines WHERE num % 17 NOT IN (3, 4) AND roles = 'system,user,assistant'),
  errors AS (SELECT num, 'R1' AS regle FROM lines WHERE num % 17 IN (3, 4)
    UNION ALL SELECT num, 'R2' FROM lines WHERE num % 17 NOT IN (3, 4) AND roles <> 'system,user,assistant'
    UNION ALL SELECT num, 'R3' FROM good WHERE length(u) < 10 UNION ALL SELECT num, 'R4' FROM good WHERE NOT dp
    UNION ALL SELECT num, 'R5' FROM (SELECT num, row_number() OVER (PARTITION BY u ORDER BY num) AS rn FROM good) WHERE rn > 1
    UNION ALL SELECT NULL, 'MIN' FROM (SELECT count(*) AS n FROM lines) WHERE n < 1000000)"""


@query(f"WITH {CORPUS} SELECT num, regle FROM errors")
def corpus_errors(i: Inputs) -> DataFrame:
    return quality.corpus_errors(reports.parse_examples(corpus(i)), 1_000_000).select("num", "regle")


@query(f"""WITH {CORPUS} SELECT (SELECT count(*) FROM lines) AS n_exemples, count(*) AS n_erreurs, count(*) = 0 AS valide
    FROM errors WHERE regle <> 'MIN'""")
def corpus_summary(i: Inputs) -> DataFrame:
    examples = reports.parse_examples(corpus(i))
    return quality.corpus_summary(examples, quality.corpus_errors(examples))


def _metrics_sql(mode: str, variant: str, view: str) -> str:
    code = "upper(trim(split_part(code, '&', 1)))" if mode == "souple" else "upper(trim(code))"
    name = f"{mode}_{variant}"
    return f"""{name}_j AS (SELECT coalesce(e.id, p.id) AS id, e.id IS NOT NULL AS e, p.id IS NOT NULL AS p
      FROM (SELECT DISTINCT id, {code} AS code FROM (SELECT id_crh AS id, code_cim11 AS code FROM v_diag)) e
      FULL JOIN (SELECT DISTINCT id, {code} AS code FROM {view}) p ON p.id = e.id AND p.code = e.code),
    {name} AS (SELECT '{variant}' AS variante, '{mode}' AS mode, count(*) FILTER (e AND p) / count(*) FILTER (p) AS pr,
      count(*) FILTER (e AND p) / count(*) FILTER (e) AS re, 2.0 * count(*) FILTER (e AND p) / (count(*) FILTER (p) + count(*) FILTER (e)) AS f1,
      (SELECT count(*) FILTER (same) / count(*) FROM (SELECT bool_and(e AND p) AS same FROM {name}_j GROUP BY id)) AS em FROM {name}_j)"""


METRICS = ",\n".join(
    _metrics_sql(mode, variant, view)
    for mode in ("strict", "souple") for variant, view in (("base", "v_codes_base"), ("finetuned", "v_codes_fine"))
) + """, wide AS (SELECT * FROM strict_base UNION ALL SELECT * FROM strict_finetuned UNION ALL SELECT * FROM souple_base
    UNION ALL SELECT * FROM souple_finetuned),
  metrics AS (SELECT 'essai' AS modele, variante, mode, unnest(['precision', 'recall', 'f1', 'exact_match']) AS metrique,
    unnest([round(pr, 4), round(re, 4), round(f1, 4), round(em, 4)]) AS valeur FROM wide)"""


def metrics(i: Inputs) -> DataFrame:
    expected = i("v_diag").select(F.col("id_crh").alias("id"), F.col("code_cim11").alias("code"))
    found = evaluate.code_metrics(expected, {"base": i("v_codes_base"), "finetuned": i("v_codes_fine")})
    return found.select(F.lit("essai").alias("modele"), "variante", "mode", "metrique", "valeur")


@query(f"WITH {METRICS} SELECT modele, variante, mode, metrique, valeur FROM metrics")
def prf_metrics(i: Inputs) -> DataFrame:
    return metrics(i)


@query(f"""WITH {METRICS}, w AS (SELECT modele, max(valeur) FILTER (variante = 'base' AND metrique = 'f1') AS f1_base,
      max(valeur) FILTER (variante = 'finetuned' AND metrique = 'f1') AS f1,
      max(valeur) FILTER (variante = 'finetuned' AND metrique = 'exact_match') AS exact_match FROM metrics WHERE mode = 'souple' GROUP BY 1)
    SELECT *, f1 IS NOT NULL AND exact_match IS NOT NULL AND f1_base IS NOT NULL AND f1 >= 0.7 AND exact_match >= 0.6 AND f1 > f1_base AS valide, concat_ws(' ; ', CASE WHEN f1 < 0.7 THEN 'F1 souple sous le seuil' END,
      CASE WHEN exact_match < 0.6 THEN 'exact match souple sous le seuil' END, CASE WHEN f1 <= f1_base THEN 'aucun gain sur la base' END) AS erreurs FROM w""")
def metric_gate(i: Inputs) -> DataFrame:
    return quality.metric_gate(metrics(i))


@query("""SELECT 'orders' AS table_name, 'o_orderstatus' AS column_name, CAST(o_orderkey AS VARCHAR) AS cle, o_orderstatus AS valeur
      FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
    UNION ALL SELECT 'diagnostic', 'type_diag', CAST(ord1 AS VARCHAR), 'XX' FROM v_diag WHERE (ord1 + ord2) % 50 = 0
    UNION ALL SELECT 'patient_fictif', 'sexe', CAST(c_custkey AS VARCHAR), CAST(c_custkey % 10 AS VARCHAR) FROM customer
      WHERE c_custkey % 10 NOT IN (1, 2, 9)""")
def check_violations(i: Inputs) -> DataFrame:
    diag = i("v_diag").withColumn("type_diag", F.expr("CASE WHEN (ord1 + ord2) % 50 = 0 THEN 'XX' ELSE type_diag END"))
    patients = i.table("customer").withColumn("sexe", (F.col("c_custkey") % 10).cast("string"))
    return concat_all([
        quality.value_violations(i.table("orders"), "o_orderkey", "o_orderstatus", ["F", "O"], "orders"),
        quality.value_violations(diag, "ord1", "type_diag", quality.DIAGNOSIS_TYPES, "diagnostic"),
        quality.value_violations(patients, "c_custkey", "sexe", quality.SEXES, "patient_fictif")])


def mapped_synonyms(i: Inputs) -> DataFrame:
    """Synonyms with the code that their ICD-10 code maps to, whether the terminology has it or not."""
    mapping = terminology.icd_map(i("v_map10"), ["ord"])
    return terminology.load_synonyms(i("v_syn"), mapping, mapping.select(F.col("icd11").alias("code")).distinct(), ORD)


@query("""SELECT 'sejour.id_patient' AS lien, CAST(o_orderkey AS VARCHAR) AS cle, CAST(o_custkey AS VARCHAR) AS reference FROM orders
      WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 4)
    UNION ALL SELECT 'diagnostic.code_cim11', CAST(ord1 AS VARCHAR), code_cim11 FROM v_diag
      WHERE code_cim11 NOT IN (SELECT code FROM v_term WHERE ord % 10 <> 0)
    UNION ALL SELECT 'diagnostic.id_crh', CAST(ord1 AS VARCHAR), CAST(id_crh AS VARCHAR) FROM v_diag
      WHERE id_crh NOT IN (SELECT id_crh FROM v_crh WHERE id_crh % 40 <> 7)
    UNION ALL SELECT 'code_postcoord.code_racine', CAST(ord1 AS VARCHAR), code_racine FROM v_pc
      WHERE code_racine NOT IN (SELECT code FROM v_term WHERE ord % 10 <> 0)
    UNION ALL SELECT 'crh.id_sejour', CAST(id_crh AS VARCHAR), CAST(id_sejour AS VARCHAR) FROM v_crh
      WHERE id_sejour NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'synonyme.code_cim11', CAST(ord1 AS VARCHAR), m.icd11 FROM v_syn s JOIN (SELECT icd10, max_by(icd11, ord) AS icd11 FROM v_map10 GROUP BY 1) m
      ON m.icd10 = s.code WHERE m.icd11 NOT IN (SELECT code FROM v_term WHERE ord % 10 <> 0)
    UNION ALL SELECT 'axe_postcoord.code_cim11', CAST(ord AS VARCHAR), code FROM v_axis_csv
      WHERE code NOT IN (SELECT code FROM v_term WHERE ord % 10 <> 0)""")
def fk_violations(i: Inputs) -> DataFrame:
    terms = i("v_term").where("ord % 10 <> 0")
    patients = i.table("customer").where("c_custkey % 11 <> 4")
    crh = i("v_crh").where("id_crh % 40 <> 7")
    return concat_all([
        quality.reference_violations(i.table("orders"), "o_orderkey", "o_custkey", patients, "c_custkey", "sejour.id_patient"),
        quality.reference_violations(i("v_diag"), "ord1", "code_cim11", terms, "code", "diagnostic.code_cim11"),
        quality.reference_violations(i("v_diag"), "ord1", "id_crh", crh, "id_crh", "diagnostic.id_crh"),
        quality.reference_violations(i("v_pc"), "ord1", "code_racine", terms, "code", "code_postcoord.code_racine"),
        quality.reference_violations(i("v_crh"), "id_crh", "id_sejour", i.table("orders"), "o_orderkey", "crh.id_sejour"),
        quality.reference_violations(mapped_synonyms(i), "ord1", "code_cim11", terms, "code", "synonyme.code_cim11"),
        quality.reference_violations(i("v_axis_csv"), "ord", "code", terms, "code", "axe_postcoord.code_cim11")])


@query("""SELECT 'code_cim11' AS table_name, code AS cle, count(*) AS n FROM v_term GROUP BY code HAVING count(*) > 1
    UNION ALL SELECT 'lineitem', l_orderkey || '|' || l_linenumber, count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def pk_duplicates(i: Inputs) -> DataFrame:
    return quality.key_duplicates(i("v_term"), ["code"], "code_cim11").unionByName(
        quality.key_duplicates(i.table("lineitem"), ["l_orderkey", "l_linenumber"], "lineitem"))


@query("""SELECT 'synonyme' AS table_name, unnest(['code', 'synonyme']) AS column_name,
    unnest([count(*) FILTER (code IS NULL), count(*) FILTER (synonyme IS NULL)]) AS n FROM v_syn""")
def required_nulls(i: Inputs) -> DataFrame:
    return quality.required_nulls(i("v_syn"), ["code", "synonyme"], "synonyme")


@query("""SELECT 'code_cim11' AS table_name, 'code' AS column_name, CAST(ord AS VARCHAR) AS cle, length(code) AS longueur FROM v_term WHERE length(code) > 6
    UNION ALL SELECT 'code_cim11', 'texte', CAST(ord AS VARCHAR), length(texte) FROM v_term WHERE length(texte) > 10""")
def length_overflow(i: Inputs) -> DataFrame:
    return quality.length_violations(i("v_term"), "ord", {"code": 6, "texte": 10}, "code_cim11")


# The eight tables with planted violations: repeated keys, nulls, long values. One projection of one table each, for Spark and DuckDB alike.
_ID = "CASE WHEN {k} % 100 = 7 THEN {k} - 1 WHEN {k} % 1000 = 11 THEN NULL ELSE {k} END"
_LONG = "repeat('x', CAST({k} % {n} AS INT))"
PLANTED_TABLES = {
    "patient_fictif": f"""SELECT {_ID.format(k='c_custkey')} AS id_patient, CASE WHEN c_custkey % 50 = 3 THEN NULL ELSE c_name END AS nom,
      {_LONG.format(k='c_custkey', n=120)} AS prenom, CAST(c_custkey % 12 AS STRING) AS sexe FROM customer""",
    "sejour": f"""SELECT {_ID.format(k='o_orderkey')} AS id_sejour, CASE WHEN o_orderkey % 60 = 5 THEN NULL ELSE o_custkey END AS id_patient,
      {_LONG.format(k='o_orderkey', n=60)} AS mode_entree, o_orderpriority AS mode_sortie, o_orderpriority AS mode_hospit,
      {_LONG.format(k='o_custkey', n=110)} AS specialite_medicale FROM orders""",
    "code_cim11": f"""SELECT CASE WHEN ord % 30 = 2 THEN code || {_LONG.format(k='ord', n=20)} ELSE code END AS code,
      CASE WHEN ord % 70 = 9 THEN NULL ELSE texte END AS libelle, type || {_LONG.format(k='ord', n=25)} AS type FROM v_term""",
    "crh": f"""SELECT {_ID.format(k='id_crh')} AS id_crh, CASE WHEN id_crh % 40 = 1 THEN NULL ELSE id_sejour END AS id_sejour,
      CASE WHEN id_crh % 80 = 2 THEN NULL ELSE texte_crh END AS texte_crh FROM v_crh""",
    "diagnostic": f"""SELECT {_ID.format(k='(ord1 * 10 + ord2)')} AS id_diagnostic, CASE WHEN ord1 % 90 = 4 THEN NULL ELSE id_crh END AS id_crh,
      CASE WHEN ord1 % 55 = 3 THEN 'DASX' ELSE type_diag END AS type_diag, code_cim11 || {_LONG.format(k='ord3', n=30)} AS code_cim11 FROM v_diag""",
    "synonyme": f"""SELECT {_ID.format(k='(ord1 * 10 + ord2)')} AS id_synonyme, code AS code_cim11, CASE WHEN ord4 % 45 = 6 THEN NULL ELSE synonyme END AS synonyme,
      {_LONG.format(k='ord3', n=220)} AS source FROM v_syn""",
    "code_postcoord": f"""SELECT code_postcoord || {_LONG.format(k='ord1', n=270)} AS code_postcoord,
      CASE WHEN ord4 % 35 = 1 THEN NULL ELSE code_racine || {_LONG.format(k='ord3', n=22)} END AS code_racine FROM v_pc""",
    "axe_postcoord": f"""SELECT {_ID.format(k='ord')} AS id_axe, CASE WHEN ord % 25 = 8 THEN NULL ELSE code END AS code_cim11, axe_nom || {_LONG.format(k='ord', n=105)} AS axe_nom,
      allow_multiple || {_LONG.format(k='ord', n=33)} AS allow_multiple FROM v_axis_csv""",
}


def _schema_sql() -> str:
    parts = []
    for name, rules in quality.SCHEMA.items():
        counts = [("cle", rules.key, f"(SELECT count(*) FROM (SELECT {rules.key} AS k FROM t_{name} GROUP BY 1 HAVING count(*) > 1 OR {rules.key} IS NULL))")]
        counts += [("nul", c, f"(SELECT count(*) FROM t_{name} WHERE {c} IS NULL)") for c in rules.required]
        counts += [("longueur", c, f"(SELECT count(*) FROM t_{name} WHERE length({c}) > {n})") for c, n in rules.lengths.items()]
        parts += [f"SELECT '{name}' AS table_name, '{rule}' AS regle, '{column}' AS column_name, {n} AS n" for rule, column, n in counts]
    tables = ", ".join(f"t_{name} AS ({sql})" for name, sql in PLANTED_TABLES.items())
    return f"WITH {tables} " + " UNION ALL ".join(parts)


@query(_schema_sql())
def schema_violations(i: Inputs) -> DataFrame:
    return concat_all([quality.schema_counts(i.sql(PLANTED_TABLES[name]), rules, name) for name, rules in quality.SCHEMA.items()])


@query("""WITH stay AS (SELECT o_orderkey AS id_sejour, o_custkey AS id_patient FROM orders),
      gone AS (SELECT id_sejour FROM stay WHERE id_patient % 10 = 0),
      crh AS (SELECT id_crh FROM v_crh WHERE id_crh IN (SELECT id_sejour FROM gone))
    SELECT 'patient_fictif' AS table_name, count(*) AS n FROM customer WHERE c_custkey % 10 <> 0
    UNION ALL SELECT 'sejour', count(*) FROM stay WHERE id_patient % 10 <> 0
    UNION ALL SELECT 'crh', count(*) FROM v_crh WHERE id_crh NOT IN (SELECT id_crh FROM crh)
    UNION ALL SELECT 'diagnostic', count(*) FROM v_diag WHERE id_crh NOT IN (SELECT id_crh FROM crh)""")
def cascade_erase(i: Inputs) -> DataFrame:
    patients = i.table("customer").select(F.col("c_custkey").alias("id_patient"))
    stays = i.table("orders").select(F.col("o_orderkey").alias("id_sejour"), F.col("o_custkey").alias("id_patient"))
    crh = i("v_crh").select("id_crh", F.col("id_crh").alias("id_sejour"))
    kept = quality.erase_patients(patients.where("id_patient % 10 = 0"), patients, stays, crh, i("v_diag"))
    return relational.table_counts(kept).withColumnRenamed("n_rows", "n")


# Codes with a Q in front are in no diagnosis, so they may be erased; one row in twenty of each child table has one.
PLANTED = "CASE WHEN {n} % 20 = 1 THEN 'Q' || {c} ELSE {c} END"


@query(f"""WITH term AS (SELECT DISTINCT code FROM v_term UNION SELECT 'Q' || code FROM v_term),
      asked AS (SELECT DISTINCT code FROM v_term WHERE ord % 4 = 1 UNION SELECT DISTINCT 'Q' || code FROM v_term WHERE ord % 4 = 1),
      gone AS (SELECT code FROM asked WHERE code NOT IN (SELECT code_cim11 FROM v_diag))
    SELECT 'code_cim11' AS table_name, count(*) AS n FROM term WHERE code NOT IN (SELECT code FROM gone)
    UNION ALL SELECT 'code_postcoord', count(*) FROM v_pc WHERE {PLANTED.format(n='ord4', c='code_racine')} NOT IN (SELECT code FROM gone)
    UNION ALL SELECT 'axe_postcoord', count(*) FROM v_axis_csv WHERE {PLANTED.format(n='ord', c='code')} NOT IN (SELECT code FROM gone)
    UNION ALL SELECT 'synonyme', count(*) FROM v_syn s JOIN (SELECT icd10, max_by(icd11, ord) AS icd11 FROM v_map10 GROUP BY 1) m ON m.icd10 = s.code
      WHERE {PLANTED.format(n='ord4', c='m.icd11')} NOT IN (SELECT code FROM gone)""")
def code_erase(i: Inputs) -> DataFrame:
    def planted(table: DataFrame, number: str, code: str) -> DataFrame:
        return table.withColumn(code, F.expr(PLANTED.format(n=number, c=code)))

    def with_planted(codes: DataFrame) -> DataFrame:
        return codes.select("code").union(codes.select(F.concat(F.lit("Q"), "code"))).distinct()

    kept = quality.erase_codes(
        with_planted(i("v_term").where("ord % 4 = 1")), with_planted(i("v_term")), i("v_diag"), {
            "code_postcoord": (planted(i("v_pc"), "ord4", "code_racine"), "code_racine"),
            "axe_postcoord": (planted(i("v_axis_csv"), "ord", "code"), "code"),
            "synonyme": (planted(mapped_synonyms(i), "ord4", "code_cim11"), "code_cim11")})
    return relational.table_counts(kept).withColumnRenamed("n_rows", "n")


@query("""WITH stay AS (SELECT o_orderkey AS id_sejour FROM orders), gone AS (SELECT id_sejour FROM stay WHERE id_sejour % 10 = 1),
      crh AS (SELECT id_crh, id_crh % 10 = 1 OR id_crh % 10 = 7 AS parti FROM v_crh)
    SELECT 'sejour' AS table_name, count(*) AS n FROM stay WHERE id_sejour % 10 <> 1
    UNION ALL SELECT 'crh', count(*) FROM crh WHERE NOT (id_crh % 10 = 7 OR id_crh IN (SELECT id_sejour FROM gone))
    UNION ALL SELECT 'diagnostic', count(*) FROM v_diag WHERE NOT (id_crh % 10 = 7 OR id_crh IN (SELECT id_sejour FROM gone))""")
def stay_erase(i: Inputs) -> DataFrame:
    stays = i.table("orders").select(F.col("o_orderkey").alias("id_sejour"))
    crh = i("v_crh").select("id_crh", F.col("id_crh").alias("id_sejour"))
    after_stays = quality.erase_stays(stays.where("id_sejour % 10 = 1"), stays, crh, i("v_diag"))
    after_reports = quality.erase_reports(crh.where("id_crh % 10 = 7"), after_stays["crh"], after_stays["diagnostic"])
    return relational.table_counts({"sejour": after_stays["sejour"], **after_reports}).withColumnRenamed("n_rows", "n")
