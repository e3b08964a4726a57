"""Training examples, coded replies, report tables, intake."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nosoflow.functions.replies import diagnosis_rows, parse_reply
from nosoflow.functions.text import unwrap_report, wrap_report
from nosoflow.operators import lookup, relational, reports, terminology
from nosoflow.plans.registry import query
from nosoflow.plans.terminology import CODES, codes
from nosoflow.plans.views import Inputs

PART = r"[A-Z0-9]{2,10}(?:\.[A-Z0-9]+)?"
LABELLED = r"([^(]+?)\s*\((" + PART + "(?:&" + PART + r")*)\)"
CLEAN = r"trim(regexp_replace(trim({}, ' ' || chr(10)), '^,+', ''), ' ' || chr(10))"
PARSED = f"""cut AS (SELECT id, reply, CASE WHEN contains(reply, 'DAS :') THEN left(reply, instr(reply, 'DAS :') - 1) ELSE reply END AS head,
    CASE WHEN contains(reply, 'DAS :') THEN substr(reply, instr(reply, 'DAS :') + 5) ELSE '' END AS tail FROM v_reply),
  main AS (SELECT id, CASE WHEN contains(head, 'DP :') AND substr(head, instr(head, 'DP :') + 4) <> '' THEN substr(head, instr(head, 'DP :') + 4)
    ELSE head END AS txt, CASE WHEN contains(lower(tail), 'aucun') THEN '' ELSE tail END AS tail FROM cut),
  diag AS (SELECT id, 1 AS rang, 'DP' AS type_diag, trim(regexp_extract(txt, '{LABELLED}', 1)) AS libelle, regexp_extract(txt, '{LABELLED}', 2) AS code
      FROM main WHERE regexp_matches(txt, '{LABELLED}')
    UNION ALL SELECT id, CASE WHEN regexp_matches(txt, '{LABELLED}') THEN 1 ELSE 0 END + k, 'DAS', {CLEAN.format('l')}, c FROM (
      SELECT id, txt, unnest(regexp_extract_all(tail, '{LABELLED}', 1)) AS l, unnest(regexp_extract_all(tail, '{LABELLED}', 2)) AS c,
        generate_subscripts(regexp_extract_all(tail, '{LABELLED}', 1), 1) AS k FROM main))"""


@query(f"""WITH {PARSED} SELECT m.id, d.libelle AS dp_libelle, d.code AS dp_code, CAST(len(regexp_extract_all(m.tail, '{LABELLED}', 2)) AS BIGINT) AS n_das
    FROM main m LEFT JOIN diag d ON d.id = m.id AND d.type_diag = 'DP'""")
def parse_replies(i: Inputs) -> DataFrame:
    parsed = i("v_reply").select("id", parse_reply(F.col("reply")).alias("r"))
    return parsed.select("id", F.col("r.dp.libelle").alias("dp_libelle"), F.col("r.dp.code").alias("dp_code"),
                         F.size("r.das").cast("bigint").alias("n_das"))


@query(f"WITH {PARSED} SELECT id, CAST(rang AS BIGINT) AS rang, type_diag, libelle, code FROM diag")
def reply_diagnoses(i: Inputs) -> DataFrame:
    rows = i("v_reply").select("id", F.posexplode(diagnosis_rows(F.col("reply"))).alias("p", "d"))
    return rows.select("id", (F.col("p") + 1).cast("bigint").alias("rang"), "d.*")


def example_lines(i: Inputs) -> DataFrame:
    """JSONL training lines: line number and raw text."""

    def message(role: str, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    text = F.concat(F.lit("Compte rendu "), F.col("id").cast("string"))
    messages = F.array(message("system", F.lit("consigne")), message("user", text), message("assistant", F.col("reply")))
    return i("v_reply").select(F.col("id").alias("num"), F.to_json(F.struct(messages.alias("messages"))).alias("brut"))


def example_reports(i: Inputs) -> DataFrame:
    return reports.example_reports(reports.parse_examples(example_lines(i)))


@query(f"""WITH {PARSED}, {CODES} SELECT id AS id_crh, CAST(rang AS BIGINT) AS rang, type_diag, code AS code_cim11, libelle AS libelle_saisi
    FROM diag WHERE code IN (SELECT code FROM codes)""")
def load_reports(i: Inputs) -> DataFrame:
    return reports.load_diagnostics(example_reports(i), codes(i))


@query("""SELECT id AS id_patient, 'Fictif' || id AS nom, 'Synthetique' AS prenom, '9' AS sexe, id AS id_sejour,
    'Non renseigne' AS specialite_medicale, 'Compte rendu ' || id AS texte_crh, true AS date_ok FROM v_reply""")
def load_stays(i: Inputs) -> DataFrame:
    rows = example_reports(i)
    patients, stays = reports.synthetic_patients(rows), reports.synthetic_stays(rows)
    texts = reports.report_table(rows).select("id_sejour", "texte_crh", F.col("date_redaction").isNotNull().alias("date_ok"))
    return patients.drop("date_naissance").join(stays, "id_patient").join(texts, "id_sejour")


@query(f"""WITH {PARSED}, {CODES} SELECT (SELECT count(*) FROM v_reply) AS n_crh,
    count(*) FILTER (code IN (SELECT code FROM codes)) AS n_diag, count(*) FILTER (code NOT IN (SELECT code FROM codes)) AS n_skipped FROM diag""")
def skipped_diagnoses(i: Inputs) -> DataFrame:
    return reports.load_counts(example_reports(i), codes(i))


@query("""SELECT p.id_crh, p.id_sejour, length(p.texte_crh) AS longueur, d.type_diag, d.code_cim11, d.ord1, d.ord2, d.ord3, d.ord4
    FROM (SELECT * FROM v_crh ORDER BY id_crh LIMIT 20 OFFSET 40) p LEFT JOIN v_diag d ON d.id_crh = p.id_crh""")
def reports_with_diagnoses(i: Inputs) -> DataFrame:
    page = terminology.reports_page(i("v_crh"), i("v_diag"), ["ord1", "ord2", "ord3", "ord4"], 20, 40)
    return page.withColumn("longueur", F.length("texte_crh").cast("bigint")).drop("texte_crh")


@query("SELECT id_crh, id_sejour, texte_crh FROM v_crh WHERE id_crh = 17")
def report_lookup(i: Inputs) -> DataFrame:
    return relational.find(i("v_crh"), "id_crh", 17)


@query(f"""WITH {PARSED}, {CODES} SELECT d.id AS id_crh, CAST(d.rang AS BIGINT) AS rang, d.code AS code_cim11,
    c.libelle AS libelle_officiel, c.code IS NOT NULL AS trouve FROM diag d LEFT JOIN codes c ON c.code = d.code""")
def crosscheck_codes(i: Inputs) -> DataFrame:
    found = lookup.crosscheck(reports.reply_diagnoses(example_reports(i)), "code_cim11", codes(i))
    return found.select("id_crh", "rang", "code_cim11", "libelle_officiel", "trouve")


INTAKE = """unknown AS (SELECT id_crh, min(code_cim11) AS code FROM v_diag WHERE code_cim11 NOT IN (SELECT code FROM most) GROUP BY 1),
  checked AS (SELECT r.id_crh, CASE WHEN r.id_sejour % 10 = 3 THEN 'sejour inconnu' WHEN u.code IS NOT NULL THEN 'code inconnu : ' || u.code END AS motif
    FROM v_crh r LEFT JOIN unknown u ON u.id_crh = r.id_crh)"""
MOST = "most AS (SELECT code FROM v_term WHERE ord % 100 <> 57)"


def intake(i: Inputs) -> DataFrame:
    known = i("v_term").where("ord % 100 <> 57").select("code").distinct()
    stays = i("v_crh").select("id_sejour").where("id_sejour % 10 <> 3")  # a stay is listed once for each of its reports
    return reports.check_intake(i("v_crh").select("id_crh", "id_sejour"), i("v_diag"), stays, known)


@query(f"WITH {MOST}, {INTAKE} SELECT id_crh, motif FROM checked")
def report_intake(i: Inputs) -> DataFrame:
    return intake(i).select("id_crh", "motif")


@query(f"""WITH {MOST}, {INTAKE} SELECT id_crh, type_diag, count(*) AS n FROM v_diag
    WHERE id_crh IN (SELECT id_crh FROM checked WHERE motif IS NULL) GROUP BY 1, 2""")
def accepted_diagnoses(i: Inputs) -> DataFrame:
    return relational.count_by(reports.accepted_diagnostics(intake(i), i("v_diag")), ["id_crh", "type_diag"])


@query("SELECT id_crh FROM v_crh WHERE length(trim(texte_crh, ' ' || chr(9) || chr(10) || chr(13))) BETWEEN 10 AND 20000")
def input_gate(i: Inputs) -> DataFrame:
    return reports.length_gate(i("v_crh"), "texte_crh").select("id_crh")


@query("SELECT id_crh, md5(trim(texte_crh, ' ' || chr(9) || chr(10) || chr(13))) AS texte FROM v_crh")
def unwrap_prompt(i: Inputs) -> DataFrame:
    wrapped = F.concat(F.lit("En-tête\n"), wrap_report(F.col("texte_crh")))
    return i("v_crh").select("id_crh", F.md5(unwrap_report(wrapped)).alias("texte"))


@query("""SELECT DISTINCT code AS cle FROM (SELECT CASE WHEN ord4 % 20 = 1 THEN 'Q' || code_racine ELSE code_racine END AS code FROM v_pc)
    WHERE code NOT IN (SELECT code_cim11 FROM v_diag)""")
def remaining_keys(i: Inputs) -> DataFrame:
    planted = F.expr("CASE WHEN ord4 % 20 = 1 THEN 'Q' || code_racine ELSE code_racine END")  # units without a result
    units = i("v_pc").select(planted.alias("cle")).distinct()
    finished = i("v_diag").select(F.col("code_cim11").alias("cle"))
    return lookup.remaining(units, finished, "cle")
