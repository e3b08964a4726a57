"""Generated codes: checks, labels, prompts, batches, recovered reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nosoflow.operators import lookup, prompts, relational, sampling, verify
from nosoflow.operators.scaling import cut_lineage
from nosoflow.plans.registry import query
from nosoflow.plans.sampling import DRAWN, HASH, drawn_sql
from nosoflow.plans.terminology import CODES, ORD, codes
from nosoflow.plans.translation import LOOKUP, MAP, NORM, mapping, with_lists
from nosoflow.plans.views import Inputs

K = ", ".join(ORD)
# Valid extensions X00 to X89, from the numbers of suppliers; labels for two in three of them.
EXTENSIONS = """ext AS (SELECT DISTINCT 'X' || lpad(CAST(s_suppkey % 90 AS VARCHAR), 2, '0') AS code,
    CASE WHEN s_suppkey % 90 % 3 = 0 THEN '' ELSE 'précision ' || (s_suppkey % 90) END AS libelle FROM supplier)"""
FREE = r"[A-Za-z0-9][A-Za-z0-9.]*(?:&[A-Za-z0-9=.]+)+"
CHECKED = f"""resp AS (SELECT {K}, json_extract_string(brut, '$.custom_id') AS root,
    json_extract_string(brut, '$.response.body.choices[0].message.content') AS c FROM v_resp WHERE json_valid(brut)),
  codes_in AS (SELECT {K}, root, unnest(regexp_extract_all(c, '{FREE}')) AS code, generate_subscripts(regexp_extract_all(c, '{FREE}'), 1) AS rang FROM resp),
  seg AS (SELECT {K}, root, code, rang, unnest(string_split(code, '&')) AS s, generate_subscripts(string_split(code, '&'), 1) AS p FROM codes_in),
  checked AS (SELECT {K}, root, code, rang, string_agg(s, '|' ORDER BY p) FILTER (bad) AS inconnus FROM (
    SELECT *, s NOT IN (SELECT code FROM v_term) AND (p = 1 OR s NOT IN (SELECT code FROM ext)) AS bad FROM seg) GROUP BY ALL)"""


def extensions(i: Inputs) -> DataFrame:
    n = F.col("s_suppkey") % 90
    label = F.when(n % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("précision "), n.cast("string")))
    code = F.concat(F.lit("X"), F.lpad(n.cast("string"), 2, "0"))
    return i.table("supplier").select(code.alias("code"), label.alias("libelle")).distinct()


def responses(i: Inputs) -> DataFrame:
    return verify.read_responses(i.spread("v_resp"))


def checked(i: Inputs) -> DataFrame:
    return verify.check_codes(responses(i), ORD, codes(i), extensions(i))


@query(f"""WITH {CODES}, {EXTENSIONS}, {CHECKED},
      lab AS (SELECT {K}, rang, string_agg(CASE WHEN coalesce(e.libelle, '') = '' THEN s ELSE s || ' : ' || e.libelle END, ' | ' ORDER BY p) AS l
        FROM seg LEFT JOIN ext e ON e.code = split_part(s, '=', 1) WHERE p > 1 GROUP BY ALL)
    SELECT k.root AS code_racine, coalesce(c.libelle, '') AS libelle_racine, k.code AS code_postcoord, coalesce(lab.l, '') AS libelles_extensions
    FROM checked k LEFT JOIN lab USING ({K}, rang) LEFT JOIN codes c ON c.code = k.root WHERE k.inconnus IS NULL""")
def verify_codes(i: Inputs) -> DataFrame:
    labelled = verify.check_codes(responses(i), [], codes(i), extensions(i), with_labels=True)
    return verify.labelled_codes(verify.accepted_codes(labelled), codes(i))


@query(f"""WITH {EXTENSIONS}, {CHECKED} SELECT root AS code_racine, code AS code_postcoord, inconnus AS codes_inconnus
    FROM checked WHERE inconnus IS NOT NULL""")
def rejected_codes(i: Inputs) -> DataFrame:
    return verify.rejected_codes(checked(i))


@query(f"""WITH {EXTENSIONS}, {CHECKED}, t AS (SELECT {K}, count(*) AS n, count(*) FILTER (inconnus IS NULL) AS ok FROM checked GROUP BY ALL)
    SELECT r.ord1, r.ord2, r.ord3, r.ord4, r.ord5, r.root AS code_racine, CASE WHEN r.c IS NULL THEN 'réponse vide ou malformée'
      WHEN t.n IS NULL THEN 'aucun code extrait' ELSE 'tous les codes hallucinés' END AS erreur
    FROM resp r LEFT JOIN t USING ({K}) WHERE r.c IS NULL OR coalesce(t.ok, 0) = 0""")
def response_errors(i: Inputs) -> DataFrame:
    return verify.response_errors(responses(i), checked(i), ORD)


@query(f"""WITH {EXTENSIONS}, {CHECKED} SELECT segment, count(*) AS n FROM (
      SELECT unnest(string_split(inconnus, '|')) AS segment FROM checked WHERE inconnus IS NOT NULL)
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def unknown_segments_top(i: Inputs) -> DataFrame:
    return verify.top_unknown(verify.rejected_codes(checked(i)))


@query(f"""WITH {EXTENSIONS}, {CHECKED} SELECT count(*) FILTER (inconnus IS NULL) AS n_valides, count(inconnus) AS n_rejetes,
      count(DISTINCT root) FILTER (inconnus IS NULL) AS n_racines, round(100.0 * count(inconnus) / count(*), 2) AS pct_rejetes,
      round(count(*) FILTER (inconnus IS NULL) / count(DISTINCT root) FILTER (inconnus IS NULL), 1) AS moyenne_par_racine FROM checked""")
def rejection_rate(i: Inputs) -> DataFrame:
    return verify.rejection_rate(checked(i))


LABELS = """labels AS (SELECT code_postcoord, CASE WHEN trim(coalesce(e, '')) <> '' THEN texte || ' - ' || e ELSE texte END AS libelle FROM (
    SELECT v.code_postcoord, v.libelles_extensions AS e, t.texte, row_number() OVER (PARTITION BY v.code_postcoord
      ORDER BY ord1, ord2, ord3, ord4, ord5) AS rn FROM v_pc v JOIN v_term t ON t.ord = v.ord3) WHERE rn = 1)"""


def labels(i: Inputs) -> DataFrame:
    titles = i("v_term").select(F.col("ord").alias("ord3"), F.col("texte").alias("libelle_racine"))
    return verify.full_labels(lookup.lookup_join(i("v_pc"), titles, "ord3"), ORD)


@query(f"WITH {LABELS} SELECT code_postcoord, libelle FROM labels")
def postcoord_labels(i: Inputs) -> DataFrame:
    return labels(i)


# Verdicts on codes: some refuse, some accept in other words, some are empty or missing.
KEYED = "keyed AS (SELECT id_crh AS id, min(code_cim11) AS code_racine FROM v_diag GROUP BY 1)"
VERDICT = "CASE ord4 % 50 WHEN 0 THEN 'NON' WHEN 1 THEN ' oui ' WHEN 2 THEN 'OUI' WHEN 4 THEN 'PEUT-ETRE' END"
KEPT = f"""{KEYED}, {DRAWN}, kept AS (SELECT * FROM drawn WHERE code_postcoord NOT IN (
    SELECT code_postcoord FROM v_pc WHERE upper(trim({VERDICT})) <> 'OUI'))"""


def drawn(i: Inputs) -> DataFrame:
    """Drawn codes, kept as a table of their own: verdicts on them come back later."""
    keyed = i("v_diag").groupBy("id_crh").agg(F.min("code_cim11")).toDF("id", "code_racine")
    return cut_lineage(sampling.draw_for_rows(keyed, "id", "code_racine", i("v_pc"), "code_postcoord", 5, 5))


def kept(i: Inputs) -> DataFrame:
    verdicts = i("v_pc").where("ord4 % 50 < 8").select("code_postcoord", F.expr(VERDICT).alias("verdict"))
    return lookup.apply_verdicts(drawn(i), verdicts, ["code_postcoord"])


@query(f"WITH {KEPT} SELECT id, code_postcoord FROM kept")
def apply_verdicts(i: Inputs) -> DataFrame:
    return kept(i).select("id", "code_postcoord")


@query(f"""WITH {KEYED}, {DRAWN}, reply AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'Aucun' ELSE min(code_postcoord) || ' , ' || max(code_postcoord) END AS v,
        count(*) AS n FROM drawn GROUP BY id)
    SELECT d.id, d.code_postcoord FROM drawn d JOIN reply r ON r.id = d.id WHERE r.n <= 1 OR upper(trim(r.v)) = 'AUCUN'
      OR d.code_postcoord NOT IN (trim(split_part(upper(r.v), ',', 1)), trim(split_part(upper(r.v), ',', 2)))""")
def apply_group_verdicts(i: Inputs) -> DataFrame:
    rows = drawn(i).select("id", "code_postcoord")
    listed = F.concat_ws(" , ", F.min("code_postcoord"), F.max("code_postcoord"))
    verdicts = rows.groupBy("id").agg(listed.alias("v")).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("Aucun")).otherwise(F.col("v")).alias("verdict"))
    return lookup.apply_group_verdicts(rows, verdicts, "id", "code_postcoord")


PROMPTS = f"""{KEPT}, {LABELS}, {CODES}, prompt AS (
    SELECT k.id, row_number() OVER (PARTITION BY k.id ORDER BY k.code_postcoord) AS prompt_num, k.code_postcoord AS code, l.libelle
      FROM kept k LEFT JOIN labels l ON l.code_postcoord = k.code_postcoord
    UNION ALL SELECT y.id, 1, y.code_racine, coalesce(c.libelle, '') FROM keyed y LEFT JOIN codes c ON c.code = y.code_racine
      WHERE y.id NOT IN (SELECT id FROM kept))"""


def prompt_table(i: Inputs) -> DataFrame:
    keyed = i("v_diag").groupBy("id_crh").agg(F.min("code_cim11")).toDF("id", "code_racine")
    chosen = kept(i).select("id", F.col("code_postcoord").alias("code"))
    return prompts.prompt_rows(keyed, "id", "code_racine", chosen, labels(i), codes(i))


@query(f"WITH {PROMPTS} SELECT id, prompt_num, code, libelle FROM prompt")
def prompt_rows(i: Inputs) -> DataFrame:
    return prompt_table(i)


@query(f"WITH {PROMPTS} SELECT n AS nb_prompts, count(*) AS n FROM (SELECT id, count(*) AS n FROM prompt GROUP BY id) GROUP BY 1")
def prompts_per_stay(i: Inputs) -> DataFrame:
    return relational.group_size_distribution(prompt_table(i), ["id"], "nb_prompts")


# Verdicts of the chain: on patients, on pairs of codes, on the group of a profile; some are missing.
def _chain_sql() -> str:
    return f"""{MAP}, {CODES}, {LABELS},
      sample AS (SELECT * FROM v_profile ORDER BY -ln(({HASH.format("'7|' || id")} + 0.5) / 4503599627370496.0) / nb, id LIMIT 500),
      prof AS (SELECT id, {LOOKUP.format(n='norm')} AS code_dp, icd10_sec FROM (SELECT *, {NORM.format(c='icd10_raw')} AS norm FROM sample)),
      usable AS (SELECT * FROM prof WHERE code_dp IS NOT NULL AND right(code_dp, 1) NOT IN ('Y', 'Z')),
      items AS (SELECT id, code_dp, pos, {NORM.format(c='code')} AS norm FROM (SELECT id, code_dp, unnest(string_split(icd10_sec, ',')) AS code,
        generate_subscripts(string_split(icd10_sec, ','), 1) AS pos FROM usable WHERE icd10_sec IS NOT NULL) WHERE trim(code) <> ''),
      mapped AS (SELECT id, code_dp, pos, {LOOKUP.format(n='norm')} AS racine FROM items),
      das0 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS rang FROM mapped WHERE racine IS NOT NULL AND right(racine, 1) NOT IN ('Y', 'Z')),
      das_key AS (SELECT id || '-' || rang AS id, racine AS code_racine FROM das0), {drawn_sql('das_drawn', 'das_key', 1)},
      das1 AS (SELECT d.id, d.code_dp, d.rang, d.racine, coalesce(x.code_postcoord, d.racine) AS code FROM das0 d LEFT JOIN das_drawn x ON x.id = d.id || '-' || d.rang),
      das2 AS (SELECT * FROM das1 WHERE NOT (length(code_dp || code) % 5 = 0)),
      das3 AS (SELECT *, count(*) OVER (PARTITION BY id) AS several FROM das2),
      das4 AS (SELECT * FROM das3 WHERE several = 1 OR id % 3 = 0 OR code <> (SELECT min(m.code) FROM das2 m WHERE m.id = das3.id)),
      texts AS (SELECT d.id, string_agg('- ' || coalesce(l.libelle, c.libelle, '') || ' (CIM-11 : ' || d.code || ')', chr(10) ORDER BY rang) AS texte
        FROM das4 d LEFT JOIN labels l ON l.code_postcoord = d.code LEFT JOIN codes c ON c.code = d.racine GROUP BY d.id),
      dp_key AS (SELECT id, code_dp AS code_racine FROM usable), {drawn_sql('dp_drawn', 'dp_key', 5)},
      dp AS (SELECT id, code_postcoord AS code FROM dp_drawn WHERE NOT ((id + length(code_postcoord)) % 4 = 0)),
      prompt AS (SELECT k.id, row_number() OVER (PARTITION BY k.id ORDER BY k.code) AS prompt_num, k.code, l.libelle
        FROM dp k LEFT JOIN labels l ON l.code_postcoord = k.code
        UNION ALL SELECT u.id, 1, u.code_dp, coalesce(c.libelle, '') FROM usable u LEFT JOIN codes c ON c.code = u.code_dp WHERE u.id NOT IN (SELECT id FROM dp))
    SELECT p.id, p.prompt_num, p.code, p.libelle, coalesce(t.texte, '') AS texte_das FROM prompt p LEFT JOIN texts t ON t.id = p.id"""


def _group_verdicts(das: DataFrame) -> DataFrame:
    verdict = F.when(F.col("id") % 3 == 0, F.lit("Aucun")).otherwise(F.min("code"))
    return das.groupBy("id").agg(verdict.alias("verdict"))


@query(f"WITH {_chain_sql()}")
def report_prompts(i: Inputs) -> DataFrame:
    """The whole chain: weighted sample, translation, draws, three kinds of verdicts, texts, one row per prompt."""
    sample = cut_lineage(sampling.weighted_sample(i("v_profile"), 500, "nb", "id", 7))
    lists = lookup.translate_lists(sample.withColumn("codes", F.split("icd10_sec", ",")), "id", "codes", mapping(i), "das")
    profiles = cut_lineage(lookup.specific_profiles(lists, "icd10_raw", mapping(i)).select("id", F.col("icd11").alias("code_dp"), "das"))
    candidates = i("v_pc").select("code_racine", "code_postcoord").distinct()
    pairs = profiles.select("id", "code_dp", F.explode("das").alias("code_racine"))
    options = candidates.unionByName(pairs.select("code_racine", F.col("code_racine").alias("code_postcoord")))
    pairs = pairs.select("code_dp", "code_racine").distinct().join(options, "code_racine").select("code_dp", F.col("code_postcoord").alias("code")).distinct()
    pair_verdicts = pairs.withColumn("verdict", F.when(F.length(F.concat("code_dp", "code")) % 5 == 0, F.lit("non")).when(F.length("code") % 2 == 0, F.lit("OUI")))
    patients = profiles.select("id", F.col("code_dp").alias("code_racine")).join(candidates, "code_racine").select("id", F.col("code_postcoord").alias("code"))
    patient_verdicts = patients.withColumn("verdict", F.when((F.col("id") + F.length("code")) % 4 == 0, F.lit("NON")).otherwise(F.lit(" oui ")))
    return prompts.report_prompts(
        profiles, candidates, labels(i), codes(i), patient_verdicts, pair_verdicts, _group_verdicts, 5, 5)


@query("""SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 100 AS BIGINT) AS lot FROM v_profile WHERE los IS NOT NULL""")
def batch_chunks(i: Inputs) -> DataFrame:
    rows = i("v_profile").where(F.col("los").isNotNull()).select("id")
    return prompts.batches(rows, ["id"], F.floor(F.col("id") / 1_000_000))


def das_rows(i: Inputs) -> DataFrame:
    """Profiles with the labelled list of their translated secondary codes."""
    rows = with_lists(i).select("id", "icd11_sec")
    items = rows.select("id", F.posexplode_outer("icd11_sec").alias("p", "code"))
    named = lookup.with_fallback(items, "code", codes(i).select("code", "libelle"), "libelle", F.lit(""))
    item = F.when(F.col("code").isNotNull(), F.struct("p", "code", "libelle"))
    lists = named.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    pairs = F.transform("l", lambda x: F.struct(x["code"].alias("code"), x["libelle"].alias("libelle")))
    return lists.select("id", pairs.alias("das"))


DAS = """{lists}, das AS (SELECT t.id, string_agg('- ' || coalesce(c.libelle, '') || ' (CIM-11 : ' || t.icd11 || ')', chr(10) ORDER BY pos) AS texte,
      string_agg(chr(10) || '- ' || c.libelle || ' (' || t.icd11 || ')', '' ORDER BY pos) AS liste
    FROM mapped t LEFT JOIN codes c ON c.code = t.icd11 WHERE t.icd11 IS NOT NULL AND right(t.icd11, 1) NOT IN ('Y', 'Z') GROUP BY t.id)"""


def _das_sql() -> str:
    lists = f"""{MAP}, items AS (SELECT id, pos, {NORM.format(c='code')} AS norm FROM (
        SELECT id, unnest(string_split(icd10_sec, ',')) AS code, generate_subscripts(string_split(icd10_sec, ','), 1) AS pos
        FROM v_profile WHERE icd10_sec IS NOT NULL) WHERE trim(code) <> ''),
      mapped AS (SELECT id, pos, {LOOKUP.format(n='norm')} AS icd11 FROM items)"""
    return f"{CODES}, " + DAS.format(lists=lists)


@query(f"WITH {_das_sql()} SELECT p.id, coalesce(d.texte, '') AS texte FROM v_profile p LEFT JOIN das d ON d.id = p.id")
def das_text(i: Inputs) -> DataFrame:
    return das_rows(i).select("id", prompts.diagnosis_text(F.col("das")).alias("texte"))


@query(f"""WITH {_das_sql()} SELECT p.id, '## Scénario de départ' || chr(10) || chr(10) || 'patient ' || p.id || chr(10) || chr(10) || '---' || chr(10) || chr(10)
      || '## Codes CIM-11' || chr(10) || chr(10) || '**Diagnostic principal :** principal (' || p.icd10_raw || ')'
      || CASE WHEN d.liste IS NULL THEN '' ELSE chr(10) || chr(10) || '**Diagnostics associés :**' || d.liste END
      || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'texte ' || p.nb
      || CASE WHEN p.id % 2 = 0 THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Dictionnaire de formulations' || chr(10) || chr(10)
        || '### Diagnostics' || chr(10) || chr(10) || '**A1**' || chr(10) || '- un' || chr(10) || '- deux' || chr(10) || chr(10) || '**B2**' || chr(10) || '- trois' END AS document
    FROM v_profile p LEFT JOIN das d ON d.id = p.id""")
def report_document(i: Inputs) -> DataFrame:
    profiles = i("v_profile").join(das_rows(i), "id").select(
        "id", F.concat(F.lit("patient "), F.col("id").cast("string")).alias("user_prompt"), F.col("icd10_raw").alias("code_dp"),
        F.lit("principal").alias("libelle_dp"), "das", F.concat(F.lit("texte "), F.col("nb").cast("string")).alias("crh"),
        F.when(F.col("id") % 2 == 0, F.lit("{}")).otherwise(
            F.lit('{"diagnostics": {"A1": ["un", "deux"], "B2": ["trois"]}}')).alias("formulations"))
    return prompts.report_document(profiles)


@query("""SELECT '{"custom_id":"' || code || '","body":{"max_tokens":8000,"messages":[{"role":"system","content":"consigne"},'
      || '{"role":"user","content":"coder \\"' || texte || '\\""},{"role":"assistant","content":"{","prefix":true}]}}' AS value FROM v_term""")
def request_lines(i: Inputs) -> DataFrame:
    rows = i("v_term").select("code", F.concat(F.lit('coder "'), F.col("texte"), F.lit('"')).alias("user_prompt"))
    return prompts.request_lines(rows, F.lit("consigne"), F.lit("{"))


def answer_lines(i: Inputs) -> DataFrame:
    """Batch answers built from documents: fenced JSON, plain JSON, bare text, too short."""
    doc = F.to_json(F.struct(F.col("texte_crh").alias("CR"), F.create_map(
        F.lit("diagnostics"), F.create_map(F.col("id_crh").cast("string"), F.array(F.lit("x")))).alias("formulations")))
    kind = F.col("id_crh") % 4
    content = (
        F.when(kind == 0, F.concat(F.lit("Voici :\n```json\n"), doc, F.lit("\n```")))
        .when(kind == 1, doc).when(kind == 2, F.col("texte_crh")).otherwise(F.substring("texte_crh", 1, 30)))
    message = F.struct(F.struct(content.alias("content")).alias("message"))
    line = F.struct(F.col("id_crh").cast("string").alias("custom_id"),
                    F.struct(F.struct(F.array(message).alias("choices")).alias("body")).alias("response"))
    return i("v_crh").select(F.to_json(line).alias("brut"))


@query("""SELECT id_crh, id_sejour, md5(texte_crh) AS crh, CASE WHEN id_crh % 4 = 2 THEN '{}'
      ELSE '{"diagnostics":{"' || id_crh || '":["x"]}}' END AS formulations
    FROM v_crh WHERE id_crh % 4 < 3 AND NOT (id_crh % 4 = 2 AND length(texte_crh) < 40)""")
def batch_responses(i: Inputs) -> DataFrame:
    requests = i("v_crh").select("id_crh", "id_sejour")
    made = verify.generated_reports(verify.read_responses(answer_lines(i)), requests, "id_crh")
    return relational.keep_columns(made.withColumn("crh", F.md5("crh")), ["id_crh", "id_sejour", "crh", "formulations", "user_prompt_2"])


@query("""SELECT CAST(id_crh AS VARCHAR) AS custom_id FROM v_crh WHERE id_crh % 4 = 3 OR (id_crh % 4 = 2 AND length(texte_crh) < 40)""")
def short_responses_dropped(i: Inputs) -> DataFrame:
    rows = verify.read_responses(answer_lines(i))
    return rows.select("custom_id").join(verify.long_answers(rows).select("custom_id"), "custom_id", "left_anti")


@query("""SELECT id, replace(replace(replace(t, 'CIM-10', 'CIM-11'), 'CIM10', 'CIM-11'), '- Règle.', '- Règle.' || chr(10) || '- Ajout.') AS modele
    FROM (SELECT id, 'Coder en CIM-10 ou CIM10 : ' || icd10_raw || chr(10) || '- Règle.' AS t FROM v_profile)""")
def revised_templates(i: Inputs) -> DataFrame:
    from nosoflow.functions.text import to_new_revision

    text = F.concat(F.lit("Coder en CIM-10 ou CIM10 : "), F.col("icd10_raw"), F.lit("\n- Règle."))
    return i("v_profile").select("id", to_new_revision(text, "- Règle.", "\n- Ajout.").alias("modele"))


@query("""SELECT id, CASE WHEN n > 2 THEN left(s, length(s) - length(split_part(s, ',', 3)) - length(split_part(s, ',', 4)) - 2)
      || '|... (' || (n - 2) || ' autres codes non listés)' ELSE s END AS liste
    FROM (SELECT id, icd10_sec AS s, len(string_split(icd10_sec, ',')) AS n FROM v_profile WHERE icd10_sec <> '')""")
def capped_lists(i: Inputs) -> DataFrame:
    rows = i("v_profile").where("icd10_sec <> ''").select("id", prompts.capped_list(F.split("icd10_sec", ","), 2).alias("l"))
    return rows.select("id", F.concat_ws("|", F.array_join(F.slice("l", 1, 2), ","), F.get("l", F.lit(2))).alias("liste"))
