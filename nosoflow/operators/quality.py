"""Data quality: corpus rules, constraints of the relational tables, erasure, gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nosoflow.functions.replies import main_diagnosis
from nosoflow.functions.text import strip
from nosoflow.operators.scaling import cut_lineage, fits_broadcast, lookup_join

# Roles of an example in order, shortest report, gate thresholds.
EXPECTED_ROLES = ("system", "user", "assistant")
MIN_REPORT = 10
MIN_F1 = 0.70
MIN_EXACT_MATCH = 0.60


@dataclass(frozen=True)
class TableRules:
    """Primary key, required columns and longest values of a table."""

    key: str
    required: tuple[str, ...] = ()
    lengths: Mapping[str, int] = field(default_factory=dict)


# Constraints of the eight tables.
SCHEMA = {
    "patient_fictif": TableRules("id_patient", ("nom", "prenom"), {"nom": 100, "prenom": 100, "sexe": 1}),
    "sejour": TableRules("id_sejour", ("id_patient",), {"mode_entree": 50, "mode_sortie": 50, "mode_hospit": 10, "specialite_medicale": 100}),
    "code_cim11": TableRules("code", ("libelle",), {"code": 20, "type": 20}),
    "crh": TableRules("id_crh", ("id_sejour", "texte_crh")),
    "diagnostic": TableRules("id_diagnostic", ("id_crh", "type_diag", "code_cim11"), {"type_diag": 3, "code_cim11": 20}),
    "synonyme": TableRules("id_synonyme", ("code_cim11", "synonyme"), {"code_cim11": 20, "source": 200}),
    "code_postcoord": TableRules("code_postcoord", ("code_racine",), {"code_postcoord": 255, "code_racine": 20}),
    "axe_postcoord": TableRules("id_axe", ("code_cim11", "axe_nom"), {"code_cim11": 20, "axe_nom": 100, "allow_multiple": 30}),
}

# Allowed types of diagnosis and codes of sex.
DIAGNOSIS_TYPES = ("DP", "DAS")
SEXES = ("1", "2", "9")

# Rules and their wording.
RULES = {
    "R1": "JSON invalide ou cle 'messages' absente",
    "R2": "roles inattendus",
    "R3": "CRH trop court",
    "R4": "aucun Diagnostic Principal parsable",
    "R5": "CRH en doublon exact",
    "MIN": "jeu de donnees trop petit",
}


def _last(messages: Column, role: str) -> Column:
    """Content of the only message of a role; a missing content counts as empty."""
    return F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"], F.lit(""))


def corpus_errors(examples: DataFrame, min_examples: int = 0) -> DataFrame:
    """One row per (line, rule) broken, plus one row when the corpus is too small.

    ``examples`` comes from ``parse_examples``: ``num``, ``json_ok``, ``messages_ok``, ``messages``. A line that
    breaks R1 or R2 is not tested further. Copies are found by the smallest line number per
    report hash, then joined back on the line number, which is unique: a report copied into a
    third of the corpus never meets in one task. The outcome of the tests, a few flags and a hash per
    line, is checkpointed: the corpus itself is read and parsed once.
    """
    # a key that is present but is no list of messages has the wrong roles
    messages = F.coalesce("messages", F.array())
    roles = F.transform(messages, lambda m: m["role"])
    expected = F.array(*[F.lit(r) for r in EXPECTED_ROLES])
    report = strip(_last(messages, "user"))
    checked = cut_lineage(examples.select(
        "num",
        (F.col("json_ok") & F.col("messages_ok")).alias("r1"),
        F.coalesce(roles == expected, F.lit(False)).alias("r2"),
        (F.length(report) >= MIN_REPORT).alias("r3"),
        main_diagnosis(_last(messages, "assistant")).isNotNull().alias("r4"),
        F.sha2(report, 256).alias("empreinte"),
    ))
    passed = checked.where(F.col("r1") & F.col("r2"))
    firsts = passed.groupBy("empreinte").agg(F.min("num").alias("num")).select("num", F.lit(True).alias("premier"))
    rows = checked.drop("empreinte").join(firsts, "num", "left")
    structure = F.when(~F.col("r1"), F.array(F.lit("R1"))).when(~F.col("r2"), F.array(F.lit("R2")))
    content = F.array_compact(F.array(
        F.when(~F.col("r3"), F.lit("R3")), F.when(~F.col("r4"), F.lit("R4")), F.when(F.col("premier").isNull(), F.lit("R5"))))
    errors = rows.select("num", F.explode(F.coalesce(structure, content)).alias("regle"))
    small = checked.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < min_examples)
    errors = errors.unionByName(small.select(F.lit(None).cast("bigint").alias("num"), F.lit("MIN").alias("regle")))
    names = F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair])
    return errors.withColumn("message", names[F.col("regle")])


def corpus_summary(examples: DataFrame, errors: DataFrame) -> DataFrame:
    """Examples and number of errors; the corpus is valid when there is none."""
    n = errors.agg(F.count(F.lit(1)))
    return examples.agg(F.count(F.lit(1)).alias("n_exemples")).withColumn("n_erreurs", n.scalar()).withColumn(
        "valide", F.col("n_erreurs") == 0)


def metric_gate(metrics: DataFrame, min_f1: float = MIN_F1, min_exact: float = MIN_EXACT_MATCH) -> DataFrame:
    """Errors per model from the long table (``modele``, ``variante``, ``mode``, ``metrique``, ``valeur``).

    A missing or undefined metric is an error of its own, so the gate never opens for want of numbers.
    """

    def value(variant: str, metric: str) -> Column:
        wanted = (F.col("mode") == "souple") & (F.col("variante") == variant) & (F.col("metrique") == metric)
        return F.max(F.when(wanted, F.col("valeur")))

    wide = metrics.groupBy("modele").agg(
        value("base", "f1").alias("f1_base"), value("finetuned", "f1").alias("f1"),
        value("finetuned", "exact_match").alias("exact_match"))
    missing = [
        F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(f"métrique absente : {c}")) for c in ("f1_base", "f1", "exact_match")]
    errors = F.array_compact(F.array(
        *missing,
        F.when(F.col("f1") < min_f1, F.lit("F1 souple sous le seuil")),
        F.when(F.col("exact_match") < min_exact, F.lit("exact match souple sous le seuil")),
        F.when(F.col("f1") <= F.col("f1_base"), F.lit("aucun gain sur la base")),
    ))
    return wide.withColumn("valide", F.size(errors) == 0).withColumn("erreurs", F.array_join(errors, " ; "))


def value_violations(df: DataFrame, key: str, column: str, allowed: Sequence[str], table: str) -> DataFrame:
    """Rows whose value is outside the allowed set; null passes."""
    return df.where(~F.col(column).isin(*allowed)).select(
        F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
        F.col(key).cast("string").alias("cle"), F.col(column).cast("string").alias("valeur"))


def length_violations(df: DataFrame, key: str, lengths: Mapping[str, int], table: str) -> DataFrame:
    """Values longer than their declared length. One pass over the table for all columns."""
    tests = F.array_compact(F.array(*[
        F.when(F.length(F.col(c)) > n, F.struct(F.lit(c).alias("column_name"), F.length(F.col(c)).cast("bigint").alias("longueur")))
        for c, n in lengths.items()]))
    return df.select(F.col(key).cast("string").alias("cle"), F.explode(tests).alias("v")).select(
        F.lit(table).alias("table_name"), "v.column_name", "cle", "v.longueur")


def reference_violations(
    child: DataFrame, child_key: str, reference: str, parent: DataFrame, parent_key: str, link: str
) -> DataFrame:
    """Child rows whose reference is not null and matches no parent.

    If the child is the small side, only the parent keys that it asks for are kept, so a large parent is neither shuffled, sorted nor held.
    """
    keys = parent.select(F.col(parent_key).alias(reference))
    rows = child.select(child_key, reference).where(F.col(reference).isNotNull())
    if fits_broadcast(rows) and not fits_broadcast(keys):
        keys = lookup_join(keys, rows.select(reference).distinct(), reference, "left_semi")
    keys = keys.distinct()
    missing = lookup_join(rows, keys, reference, "left_anti")
    return missing.select(
        F.lit(link).alias("lien"), F.col(child_key).cast("string").alias("cle"), F.col(reference).cast("string").alias("reference"))


def key_duplicates(df: DataFrame, keys: Sequence[str], table: str) -> DataFrame:
    """Primary keys that occur more than once."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return counted.select(F.lit(table).alias("table_name"), F.concat_ws("|", *keys).alias("cle"), "n")


def required_nulls(df: DataFrame, columns: Sequence[str], table: str) -> DataFrame:
    """Nulls per required column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in columns])
    return counts.select(F.explode(pairs).alias("p")).select(F.lit(table).alias("table_name"), "p.column_name", "p.n")


def schema_counts(df: DataFrame, rules: TableRules, table: str) -> DataFrame:
    """Number of violations of each constraint of a table: ``table_name``, ``regle``, ``column_name``, ``n``.

    ``cle`` counts the keys that are null or occur more than once, ``nul`` the nulls of a required column, ``longueur`` its values that
    are too long. Nulls and lengths take one pass, keys one aggregate.
    """
    counts = {("nul", c): F.count_if(F.col(c).isNull()) for c in rules.required}
    counts |= {("longueur", c): F.count_if(F.length(c) > n) for c, n in rules.lengths.items()}
    names = {kind: f"n{k}" for k, kind in enumerate(counts)}
    keys = df.groupBy(rules.key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(rules.key).isNull())
    found = keys.agg(F.count(F.lit(1)).alias("n")).select(F.lit("cle").alias("regle"), F.lit(rules.key).alias("column_name"), "n")
    rows = df.agg(*[c.alias(names[kind]) for kind, c in counts.items()]) if counts else None
    if rows is not None:
        cells = F.array(*[F.struct(F.lit(rule).alias("regle"), F.lit(c).alias("column_name"), F.col(names[rule, c]).alias("n")) for rule, c in counts])
        found = found.unionByName(rows.select(F.explode(cells).alias("c")).select("c.*"))
    return found.select(F.lit(table).alias("table_name"), "regle", "column_name", "n")


def volume_check(codes: DataFrame, reports: DataFrame, min_codes: int = 1000, min_reports: int = 1) -> DataFrame:
    """Counts of codes and reports and whether the base is large enough."""
    n_codes = codes.agg(F.count(F.lit(1)).alias("n_codes"))
    return n_codes.withColumn("n_crh", reports.agg(F.count(F.lit(1))).scalar()).withColumn(
        "valide", (F.col("n_codes") > min_codes) & (F.col("n_crh") >= min_reports))


def erase_patients(
    erased: DataFrame, patients: DataFrame, stays: DataFrame, reports: DataFrame, diagnostics: DataFrame
) -> dict[str, DataFrame]:
    """Tables without the erased patients and everything that hangs on them."""
    kept_patients = lookup_join(patients, erased.select("id_patient"), "id_patient", "left_anti")
    gone = lookup_join(stays, erased.select("id_patient"), "id_patient", "left_semi")
    return {"patient_fictif": kept_patients, **erase_stays(gone, stays, reports, diagnostics)}


def erase_stays(erased: DataFrame, stays: DataFrame, reports: DataFrame, diagnostics: DataFrame) -> dict[str, DataFrame]:
    """Tables without the erased stays and everything that hangs on them."""
    ids = erased.select("id_sejour").distinct()
    gone = lookup_join(reports, ids, "id_sejour", "left_semi")
    return {"sejour": lookup_join(stays, ids, "id_sejour", "left_anti"), **erase_reports(gone, reports, diagnostics)}


def erase_reports(erased: DataFrame, reports: DataFrame, diagnostics: DataFrame) -> dict[str, DataFrame]:
    """Tables without the erased reports and their diagnoses."""
    ids = erased.select("id_crh").distinct()
    return {"crh": lookup_join(reports, ids, "id_crh", "left_anti"), "diagnostic": lookup_join(diagnostics, ids, "id_crh", "left_anti")}


def erasable_codes(asked: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Codes asked to be erased, with a flag: a code still used by a diagnosis may not be."""
    used = diagnostics.select(F.col("code_cim11").alias("code")).distinct().withColumn("_used", F.lit(True))
    return asked.join(used, "code", "left").select("code", F.col("_used").isNull().alias("effacable"))


def erase_codes(
    asked: DataFrame, codes: DataFrame, diagnostics: DataFrame, children: Mapping[str, tuple[DataFrame, str]]
) -> dict[str, DataFrame]:
    """Code table and its child tables without the erasable codes. ``children`` maps a name to (table, code column)."""
    gone = erasable_codes(asked, diagnostics).where("effacable").select("code")
    kept = {"code_cim11": lookup_join(codes, gone, "code", "left_anti")}
    for name, (table, column) in children.items():
        kept[name] = lookup_join(table, gone.select(F.col("code").alias(column)), column, "left_anti")
    return kept


def non_empty(df: DataFrame, message: str) -> DataFrame:
    """The same rows; the query fails when there is none, so drift never gives an empty output."""
    counted = df.limit(1).agg(F.count(F.lit(1)).alias("n"))  # existence test: each task stops at its first row
    guard = counted.where(F.assert_true(F.col("n") > 0, message).isNotNull())
    return df.unionByName(guard.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))
