"""Training examples and reports: reading, relational tables, intake with reference checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nosoflow.functions.replies import MESSAGES_TYPE, diagnosis_rows, message_of
from nosoflow.functions.text import strip
from nosoflow.operators.scaling import lookup_join

# Columns of a synthetic patient and stay.
SYNTHETIC_PREFIX, SYNTHETIC_FIRST_NAME, UNKNOWN_SEX = "Fictif", "Synthetique", "9"
UNKNOWN_SPECIALTY = "Non renseigne"


def parse_examples(lines: DataFrame) -> DataFrame:
    """Raw JSONL lines (``num``, ``brut``) with parsed messages; nulls tell what failed."""
    stripped = strip(F.col("brut"))
    parsed = lines.where(stripped != "").withColumn("_doc", F.try_parse_json(stripped))
    present = F.try_variant_get("_doc", "$.messages", "variant")
    return parsed.withColumns({
        "json_ok": F.col("_doc").isNotNull(),
        "messages_ok": present.isNotNull(),
        "messages": F.try_variant_get("_doc", "$.messages", MESSAGES_TYPE),
    }).drop("_doc")


def example_reports(examples: DataFrame) -> DataFrame:
    """Report text and coded reply of each example: first user and first assistant message."""
    return examples.select(
        F.col("num").alias("id_crh"),
        message_of(F.col("messages"), "user").alias("texte_crh"),
        message_of(F.col("messages"), "assistant").alias("reponse"),
    )


def synthetic_patients(reports: DataFrame) -> DataFrame:
    return reports.select(
        F.col("id_crh").alias("id_patient"),
        F.concat(F.lit(SYNTHETIC_PREFIX), F.col("id_crh").cast("string")).alias("nom"),
        F.lit(SYNTHETIC_FIRST_NAME).alias("prenom"),
        F.lit(None).cast("date").alias("date_naissance"),
        F.lit(UNKNOWN_SEX).alias("sexe"),
    )


def synthetic_stays(reports: DataFrame) -> DataFrame:
    return reports.select(
        F.col("id_crh").alias("id_sejour"), F.col("id_crh").alias("id_patient"),
        F.lit(UNKNOWN_SPECIALTY).alias("specialite_medicale"))


def report_table(reports: DataFrame, written=None) -> DataFrame:
    """Report rows with a default timestamp of writing where none is given."""
    stamp = F.col(written) if written else F.lit(None).cast("timestamp")
    return reports.select(
        "id_crh", F.col("id_crh").alias("id_sejour"), "texte_crh",
        F.coalesce(stamp, F.current_timestamp()).alias("date_redaction"))


def reply_diagnoses(reports: DataFrame) -> DataFrame:
    """One row per diagnosis of a reply, with its rank."""
    return reports.select("id_crh", F.posexplode(diagnosis_rows(F.col("reponse"))).alias("rang", "d")).select(
        "id_crh", (F.col("rang") + 1).cast("bigint").alias("rang"), "d.type_diag",
        F.col("d.code").alias("code_cim11"), F.col("d.libelle").alias("libelle_saisi"))


def load_diagnostics(reports: DataFrame, codes: DataFrame) -> DataFrame:
    """Diagnoses whose code is loaded."""
    keys = codes.select(F.col("code").alias("code_cim11"))
    return lookup_join(reply_diagnoses(reports), keys, "code_cim11", "left_semi")


def load_counts(reports: DataFrame, codes: DataFrame) -> DataFrame:
    """Reports, loaded diagnoses and skipped diagnoses."""
    keys = codes.select(F.col("code").alias("code_cim11"), F.lit(1).alias("_known"))
    rows = lookup_join(reply_diagnoses(reports), keys, "code_cim11", "left")
    diag = rows.agg(F.count_if(F.col("_known").isNotNull()).alias("n_diag"), F.count_if(F.col("_known").isNull()).alias("n_skipped"))
    return diag.withColumn("n_crh", reports.agg(F.count(F.lit(1))).scalar()).select("n_crh", "n_diag", "n_skipped")


def check_intake(reports: DataFrame, diagnostics: DataFrame, stays: DataFrame, codes: DataFrame) -> DataFrame:
    """Reason for which each new report is refused, null when it is accepted.

    An unknown stay or a single unknown code refuses the whole report. ``reports`` has
    ``id_crh``, ``id_sejour``; ``diagnostics`` has ``id_crh``, ``code_cim11``. The codes of a report are
    reduced to one row by a map-side aggregate, never listed. Each report gives one row, however often its stay or a code is repeated in the tables.
    """
    known_codes = codes.select(F.col("code").alias("code_cim11"))
    unknown = lookup_join(diagnostics.select("id_crh", "code_cim11"), known_codes, "code_cim11", "left_anti")
    first_unknown = unknown.groupBy("id_crh").agg(F.min("code_cim11").alias("_code"))
    known_stays = stays.select("id_sejour").distinct().withColumn("_stay", F.lit(True))
    checked = lookup_join(reports, known_stays, "id_sejour", "left").join(first_unknown, "id_crh", "left")
    reason = F.when(F.col("_stay").isNull(), F.lit("sejour inconnu")).when(
        F.col("_code").isNotNull(), F.concat(F.lit("code inconnu : "), F.col("_code")))
    return checked.withColumn("motif", reason).drop("_stay", "_code")


def one_delivery(reports: DataFrame, key: str = "id_crh") -> tuple[DataFrame, DataFrame]:
    """One of the rows of each key, and the others. Equal rows are copies; of different ones the first by its hash stays, so a retried task chooses alike."""
    content = [F.to_json(F.struct(c)) if c != key else F.col(c) for c in reports.columns]
    ranked = reports.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*content), *content)))
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").drop("_n")


def accepted_diagnostics(checked: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Diagnoses of accepted reports."""
    accepted = checked.where(F.col("motif").isNull()).select("id_crh")
    return lookup_join(diagnostics, accepted, "id_crh", "left_semi")


def length_gate(reports: DataFrame, text: str, minimum: int = 10, maximum: int = 20_000) -> DataFrame:
    """Reports whose stripped text length is within the accepted range."""
    return reports.where(F.length(strip(F.col(text))).between(minimum, maximum))
