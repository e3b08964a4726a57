"""Terminology tree: descent, chapters, axes, combination counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nosoflow.operators import hierarchy as h
from nosoflow.operators import prompts
from nosoflow.operators.scaling import ordinals
from nosoflow.plans.registry import query
from nosoflow.plans.views import Inputs

# The fixture tree is small, so the size above which an axis is "too large" is lowered.
LIMIT = 300

REACHED = """reached AS (
    SELECT DISTINCT start_id, start_id AS id FROM v_axis WHERE start_id IN (SELECT id FROM v_node)
    UNION SELECT r.start_id, n.id FROM reached r JOIN v_node n ON n.parent = r.id),
  val AS (SELECT DISTINCT a.root, a.axe, a.allow_multiple, r.id, n.code FROM v_axis a
    JOIN reached r ON r.start_id = a.start_id JOIN v_node n ON n.id = r.id WHERE n.code IS NOT NULL),
  sizes AS (SELECT a.root, a.axe, a.allow_multiple, count(v.id) AS n FROM v_axis a
    LEFT JOIN val v ON v.root = a.root AND v.axe = a.axe GROUP BY 1, 2, 3)"""
CHAPTERS = """first_level AS (SELECT id, printf('%02d - %s', row_number() OVER (ORDER BY id), title) AS chapitre
    FROM v_node WHERE parent = 0),
  chap AS (SELECT id, chapitre, 1 AS visits FROM first_level
    UNION ALL SELECT n.id, c.chapitre, c.visits + 1 FROM chap c JOIN v_node n ON n.parent = c.id WHERE c.visits < {visits}),
  chapter AS (SELECT n.id, coalesce(c.chapitre, 'Chapitre inconnu') AS chapitre FROM v_node n LEFT JOIN chap c ON c.id = n.id)"""


def edges(i: Inputs) -> DataFrame:
    return i("v_node").where(F.col("parent").isNotNull()).select("parent", F.col("id").alias("child"))


def reached(i: Inputs) -> DataFrame:
    return h.descendants(i("v_axis"), i("v_node"), edges(i))


def sizes(i: Inputs) -> DataFrame:
    return h.tree_axis_sizes(i("v_axis"), i("v_node"), edges(i))


def chapter(i: Inputs, visits: int = h.MAX_VISITS) -> DataFrame:
    children = edges(i).where("parent = 0").select(F.col("child").alias("id"))
    labels = h.chapter_labels(ordinals(children, ["id"], F.floor(F.col("id") / 1_000_000)), i("v_node"))
    return h.chapters(i("v_node"), edges(i), labels, visits)


@query("""SELECT id, code FROM v_node WHERE code IS NOT NULL AND id NOT IN (SELECT parent FROM v_node WHERE parent IS NOT NULL)""")
def leaf_nodes(i: Inputs) -> DataFrame:
    return h.leaf_codes(i("v_node"), edges(i))


@query(f"WITH RECURSIVE {REACHED} SELECT r.start_id, r.id, n.code FROM reached r JOIN v_node n ON n.id = r.id")
def descendants(i: Inputs) -> DataFrame:
    return reached(i)


@query(f"WITH RECURSIVE {REACHED} SELECT root, axe, allow_multiple, n FROM sizes")
def axis_sizes(i: Inputs) -> DataFrame:
    return sizes(i)


@query(f"""WITH RECURSIVE {REACHED} SELECT a.root, a.axe, count(v.id) AS n FROM v_axis a
    LEFT JOIN val v ON v.root = a.root AND v.axe = a.axe AND starts_with(v.code, 'X') GROUP BY 1, 2""")
def extension_sizes(i: Inputs) -> DataFrame:
    extensions = i("v_node").withColumn("code", F.when(F.startswith("code", F.lit("X")), F.col("code")))
    return h.tree_axis_sizes(i("v_axis"), extensions, edges(i)).select("root", "axe", "n")


@query(f"WITH RECURSIVE {REACHED} SELECT DISTINCT root, code FROM val")
def root_pairs(i: Inputs) -> DataFrame:
    return h.root_pairs(h.axis_values(i("v_axis"), reached(i)))


FACTORS = """f AS (SELECT root, count(*) AS nb_axes,
    max(CASE WHEN axe = 1 THEN 1 + n END)::HUGEINT * max(CASE WHEN axe = 2 THEN 1 + n END) * max(CASE WHEN axe = 3 THEN 1 + n END) - 1 AS c,
    sum(log10(1.0 + n)) AS lg FROM sizes GROUP BY root)"""


@query(f"""WITH RECURSIVE {REACHED}, {FACTORS}
    SELECT root, nb_axes, CAST(c AS VARCHAR) AS nb_combinaisons,
      CASE WHEN c < 1000000 THEN format('{{:,}}', CAST(c AS BIGINT))
        ELSE left(CAST(c AS VARCHAR), 1) || '.' || substr(CAST(c AS VARCHAR), 2, 5) || ' × 10^' || (length(CAST(c AS VARCHAR)) - 1)
          || ' (~10^' || printf('%.1f', log10(CAST(c AS DOUBLE))) || ')' END AS affichage
    FROM f""")
def combinations(i: Inputs) -> DataFrame:
    from nosoflow.functions.numbers import format_big

    return h.combinations(sizes(i)).select("root", "nb_axes", "nb_combinaisons", format_big(F.col("nb_combinaisons")).alias("affichage"))


# Powers of two as lists of 9-digit limbs, doubled step by step, and all digits of a list of limbs, with carries from the lowest limb on.
POWERS = """pow2(k, limbs) AS (SELECT 0, [1::BIGINT]
    UNION ALL SELECT k + 1, [(2 * coalesce(limbs[j], 0)) % 1000000000 + CASE WHEN j > 1 AND 2 * limbs[j - 1] >= 1000000000 THEN 1 ELSE 0 END
      FOR j IN range(1, len(limbs) + 2) IF j <= len(limbs) OR 2 * limbs[j - 1] >= 1000000000] FROM pow2
    WHERE k < (SELECT max(n) FROM sizes WHERE allow_multiple = 'AllowAlways'))"""


def sql_digits(limbs: str, add: int = 0) -> str:
    """SQL for all digits of a list of limbs, which may be sums or multiples, plus ``add``."""
    start = f"[{{'t': '', 'c': {add}::BIGINT, 'v': 0::BIGINT}}]"
    low = "((x.v + a.c) % 1000000000 + 1000000000) % 1000000000"
    step = f"{{'t': lpad(({low})::VARCHAR, 9, '0') || a.t, 'c': (x.v + a.c - {low}) // 1000000000, 'v': 0::BIGINT}}"
    last = "{'t': '', 'c': 0::BIGINT, 'v': 0::BIGINT}"
    reduced = f"list_reduce({start} || [{{'t': '', 'c': 0::BIGINT, 'v': l::BIGINT}} FOR l IN {limbs}] || [{last}, {last}], lambda a, x: {step})"
    return f"CASE WHEN ltrim({reduced}.t, '0') = '' THEN '0' ELSE ltrim({reduced}.t, '0') END"


SUBSETS = f"""{POWERS},
  parts AS (SELECT root, max(CASE WHEN axe = 1 THEN n END) AS n1, max(CASE WHEN axe = 2 THEN 1 + n END) * max(CASE WHEN axe = 3 THEN 1 + n END) AS f,
    round(max(CASE WHEN axe = 1 THEN n * log10(2.0) END) + max(CASE WHEN axe = 2 THEN log10(1.0 + n) END) + max(CASE WHEN axe = 3 THEN log10(1.0 + n) END), 6) AS lg
    FROM sizes GROUP BY root),
  multiplied AS (SELECT root, lg, [l * f FOR l IN limbs] AS limbs FROM parts JOIN pow2 ON k = n1)"""


@query(f"""WITH RECURSIVE {REACHED}, {SUBSETS}
    SELECT root, lg AS log10_combinaisons, {sql_digits('limbs', -1)} AS nb_combinaisons FROM multiplied""")
def subset_combinations(i: Inputs) -> DataFrame:
    combos = h.combinations(sizes(i), allow_multiple_as_subsets=True)
    return combos.select("root", F.round("log10_combinaisons", 6).alias("log10_combinaisons"), "nb_combinaisons")


@query("WITH RECURSIVE " + CHAPTERS.format(visits=15) + " SELECT id, chapitre FROM chapter")
def chapter_of(i: Inputs) -> DataFrame:
    return chapter(i)


@query("WITH RECURSIVE " + CHAPTERS.format(visits=4) + " SELECT chapitre, count(*) AS n FROM chapter GROUP BY 1")
def chapter_depth(i: Inputs) -> DataFrame:
    return chapter(i, visits=4).groupBy("chapitre").agg(F.count(F.lit(1)).alias("n"))


SUMMARY = f"""{FACTORS}, usable AS (SELECT root FROM sizes GROUP BY root HAVING max(n) <= {LIMIT}),
  np AS (SELECT root, count(DISTINCT code) AS nb_couples FROM val GROUP BY root),
  summary AS (SELECT u.root, c.chapitre, f.nb_axes, coalesce(np.nb_couples, 0) AS nb_couples, f.c, f.lg
    FROM usable u JOIN f ON f.root = u.root LEFT JOIN np ON np.root = u.root JOIN chapter c ON c.id = u.root)"""


def summary(i: Inputs) -> DataFrame:
    kept = h.countable_axes(i("v_axis"), i("v_node"), edges(i), LIMIT)
    roots = kept.axes.select("root").distinct()
    return h.root_summary(roots, h.root_pairs(h.axis_values(kept.axes, kept.reached)), h.combinations(kept.sizes), chapter(i))


@query(f"""WITH RECURSIVE {REACHED}, {CHAPTERS.format(visits=15)}, {SUMMARY}
    SELECT chapitre, count(*) AS nb_racines, CAST(sum(nb_couples) AS BIGINT) AS nb_couples, CAST(sum(c) AS VARCHAR) AS nb_combinaisons,
      round(max(lg), 6) AS log10_max FROM summary GROUP BY 1""")
def chapter_rollup(i: Inputs) -> DataFrame:
    return h.chapter_rollup(summary(i)).withColumn("log10_max", F.round("log10_max", 6))


@query(f"""WITH RECURSIVE {REACHED}, {CHAPTERS.format(visits=15)}, {SUBSETS},
  places AS (SELECT c.chapitre, p.place, sum(m.limbs[p.place]) AS v FROM multiplied m JOIN chapter c ON c.id = m.root
    JOIN (SELECT unnest(range(1, 1 + (SELECT max(len(limbs)) FROM multiplied))) AS place) p ON p.place <= len(m.limbs) GROUP BY 1, 2),
  totals AS (SELECT chapitre, list(v ORDER BY place) AS limbs FROM places GROUP BY 1),
  counted AS (SELECT c.chapitre, count(*) AS nb_racines, round(max(m.lg), 6) AS log10_max FROM multiplied m JOIN chapter c ON c.id = m.root GROUP BY 1)
    SELECT k.chapitre, k.nb_racines, {sql_digits("([t.limbs[1] - k.nb_racines] || t.limbs[2:])")} AS nb_combinaisons, k.log10_max
    FROM counted k JOIN totals t ON t.chapitre = k.chapitre""")
def subset_rollup(i: Inputs) -> DataFrame:
    """Totals per chapter where several values of an axis go together: numbers of hundreds of digits."""
    combos = h.combinations(sizes(i), allow_multiple_as_subsets=True)
    none = combos.select("root").limit(0).withColumn("code", F.lit(""))
    rollup = h.chapter_rollup(h.root_summary(combos.select("root"), none, combos, chapter(i)))
    return rollup.select("chapitre", "nb_racines", "nb_combinaisons", F.round("log10_max", 6).alias("log10_max"))


@query(f"""WITH RECURSIVE {REACHED}, {CHAPTERS.format(visits=15)}, {SUMMARY}
    SELECT count(*) FILTER (c = 0) AS n_zero, count(*) FILTER (c > 200) AS n_above, CAST(max(c) AS VARCHAR) AS maximum,
      CAST(sum(c) AS VARCHAR) AS total, round(max(lg), 6) AS log10_max FROM summary""")
def combination_statistics(i: Inputs) -> DataFrame:
    return h.combination_statistics(summary(i)).withColumn("log10_max", F.round("log10_max", 6))


def impossible(i: Inputs) -> DataFrame:
    roots = h.countable_axes(i("v_axis"), i("v_node"), edges(i), LIMIT).impossible
    coded = i("v_term").select(F.col("ord").alias("root"), "code")
    return roots.join(coded, "root").select("code")


IMPOSSIBLE = f"imp AS (SELECT DISTINCT t.code FROM sizes s JOIN v_term t ON t.ord = s.root GROUP BY s.root, t.code HAVING max(s.n) > {LIMIT})"


@query(f"""WITH RECURSIVE {REACHED}, {IMPOSSIBLE} SELECT code, libelle FROM (
      SELECT code, texte AS libelle, row_number() OVER (PARTITION BY code ORDER BY ord) AS rn FROM v_term WHERE type = 'title')
    WHERE rn = 1 AND code IN (SELECT code FROM imp) ORDER BY code""")
def impossible_roots(i: Inputs) -> DataFrame:
    return h.impossible_roots(impossible(i), i("v_term"), ["ord"]).orderBy("code")


# Titles of two codes in three stand under another code.
TITLED = "CASE WHEN ord % 3 = 0 THEN code ELSE 'Q' || code END"


@query(f"WITH RECURSIVE {REACHED}, {IMPOSSIBLE} SELECT code FROM imp WHERE code NOT IN (SELECT {TITLED} FROM v_term WHERE type = 'title')")
def roots_without_label(i: Inputs) -> DataFrame:
    return h.without_label(impossible(i), i("v_term").where("type = 'title'").select(F.expr(TITLED).alias("code")))


@query(f"""WITH RECURSIVE {REACHED}, usable AS (SELECT root FROM sizes GROUP BY root HAVING max(n) <= {LIMIT}),
      axes AS (SELECT root, axe, allow_multiple, string_agg(code || '=' || title, ',' ORDER BY id) AS v
        FROM (SELECT val.*, n.title FROM val JOIN v_node n ON n.id = val.id) WHERE root IN (SELECT root FROM usable) GROUP BY 1, 2, 3)
    SELECT root, string_agg(axe || ':' || allow_multiple || ':' || v, ';' ORDER BY axe) AS axes FROM axes GROUP BY root""")
def axes_nested(i: Inputs) -> DataFrame:
    values = h.axis_values(i("v_axis"), reached(i))
    labels = i("v_node").where(F.col("code").isNotNull()).select("code", F.col("title").alias("libelle"))
    nested = h.nested_axes(values, h.axis_sizes(i("v_axis"), values), labels, LIMIT)

    def shown(a):
        items = F.transform(a["valeurs"], lambda v: F.concat_ws("=", v["code"], v["libelle"]))
        return F.concat_ws(":", a["axe"].cast("string"), a["allow_multiple"], F.array_join(items, ","))

    return nested.select("root", F.array_join(F.transform("axes", shown), ";").alias("axes"))


def node_documents(i: Inputs) -> DataFrame:
    """Node documents with three axes, one of them an alternative, and an absent multiplicity rule."""
    uri = F.concat(F.lit("http://id.example.org/mms/"), F.col("id").cast("string"))

    def axis(name: str, rule, start):
        target = F.array(F.concat(F.lit("http://id.example.org/mms/"), start.cast("string")))
        return F.struct(
            F.lit("http://id.example.org/schema/" + name).alias("axisName"), rule.cast("string").alias("allowMultipleValues"),
            target.alias("scaleEntity"))

    scale = F.array(
        axis("hasSeverity", F.lit("AllowAlways"), F.col("id") * 2), axis("hasAlternativeSeverity1", F.lit(None), F.col("id") * 3),
        axis("specificAnatomy", F.lit(None), F.col("id") * 4))
    empty = F.array().cast("array<struct<axisName:string,allowMultipleValues:string,scaleEntity:array<string>>>")
    return i("v_node").select(uri.alias("uri"), F.when(F.col("id") % 20 == 1, scale).otherwise(empty).alias("postcoordinationScale"))


@query("""SELECT 'https://id.example.org/mms/' || id AS uri, axe_nom, allow_multiple, 'https://id.example.org/mms/' || start AS start_uri
    FROM (SELECT id, 'hasSeverity' AS axe_nom, 'AllowAlways' AS allow_multiple, id * 2 AS start FROM v_node
      UNION ALL SELECT id, 'specificAnatomy', 'NotAllowed', id * 4 FROM v_node) WHERE id % 20 = 1""")
def node_axes(i: Inputs) -> DataFrame:
    return h.axes_of_nodes(node_documents(i))


@query(f"""WITH RECURSIVE {REACHED}, ranked AS (SELECT val.*, n.title, row_number() OVER (PARTITION BY root, axe ORDER BY val.id) AS rn
        FROM val JOIN v_node n ON n.id = val.id),
      lines AS (SELECT root, axe, string_agg('    - ' || code || ' : ' || title, chr(10) ORDER BY id) AS l FROM ranked WHERE rn <= 100 GROUP BY 1, 2),
      blocks AS (SELECT s.root, s.axe, row_number() OVER (PARTITION BY s.root ORDER BY s.axe) AS k, s.n, s.allow_multiple, l.l
        FROM sizes s JOIN lines l ON l.root = s.root AND l.axe = s.axe),
      texts AS (SELECT root, count(*) AS n, string_agg('AXE ' || k || ' — axe ' || axe || chr(10) || '  Règle : ' ||
          CASE WHEN allow_multiple = 'NotAllowed' THEN 'NotAllowed = une seule valeur autorisée'
            ELSE 'AllowAlways = plusieurs valeurs autorisées simultanément' END || chr(10)
          || '  Codes d''extension autorisés (' || n || ') :' || chr(10) || l || chr(10)
          || CASE WHEN n > 100 THEN '    ... (' || (n - 100) || ' autres codes non listés)' || chr(10) ELSE '' END || chr(10), '' ORDER BY axe) AS t
        FROM blocks GROUP BY root)
    SELECT t.code, 'CODE RACINE À POST-COORDONNER' || chr(10) || 'Code    : ' || t.code || chr(10) || 'Libellé : ' || t.texte || chr(10) || chr(10)
      || 'AXES DE POST-COORDINATION DISPONIBLES (' || x.n || ') :' || chr(10) || chr(10) || x.t
      || 'TÂCHE : génère jusqu''à 100 codes post-coordonnés RÉALISTES pour ce code racine.' || chr(10)
      || 'CONTRAINTE : utilise UNIQUEMENT les codes d''extension listés ci-dessus.' || chr(10)
      || 'Format de sortie : un JSON avec une clé ''codes_postcoord'' contenant la liste des codes.' AS user_prompt
    FROM texts x JOIN v_term t ON t.ord = x.root""")
def axis_prompts(i: Inputs) -> DataFrame:
    return axis_prompt_rows(i)


def axis_prompt_rows(i: Inputs) -> DataFrame:
    values = h.axis_values(i("v_axis"), reached(i))
    axes = h.axis_sizes(i("v_axis"), values)
    named = values.join(i("v_node").select("id", F.col("title").alias("libelle")), "id")
    labels = i("v_term").select(F.col("ord").alias("root"), F.col("code").alias("code_racine"), F.col("texte").alias("libelle_racine"))
    axis_name = F.concat(F.lit("axe "), F.col("axe").cast("string"))
    return prompts.axis_prompts(named.withColumn("axe", axis_name), axes.withColumn("axe", axis_name), labels)
