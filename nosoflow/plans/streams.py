"""Streaming forms of the monitoring and intake queries: same rows as the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nosoflow.operators.scaling import work_folder
from nosoflow.plans.monitoring import ALERTS, HOURS, ROLLING
from nosoflow.plans.registry import query
from nosoflow.plans.views import Inputs
from nosoflow.streaming import jobs

# Statements of v_pred, which streams compute on the events as they arrive.
PREDICTION = [
    "event_id", "ts", "user_id AS model_id", "value AS latence_ms", "event_type = 'error' AS is_error",
    "(event_type = 'view' AND value < 10) AS dp_missing", "'texte ' || props AS texte"]


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose state has one partition per core, not a fixed number."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return session


def predictions(i: Inputs) -> DataFrame:
    schema = i.table("events").schema
    rows = jobs.read_files(stream_session(i.spark), f"{i.folder}/events*.parquet", schema).selectExpr(*PREDICTION)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query(HOURS)
def stream_counters(i: Inputs) -> DataFrame:
    out, state = work_folder(i.spark, "compteurs"), work_folder(i.spark, "etat")
    jobs.count_windows(predictions(i), out, state, "ts", ["model_id"], "1 hour", "10 minutes")
    windows = jobs.latest_windows(i.spark, out, ["model_id"])
    # the event times carry no zone and were read as UTC
    hour = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_seconds(debut))")
    return windows.select(hour.alias("heure"), "model_id", "nb_requetes", "nb_erreurs", "nb_anomalies_dp_manquant")


@query(HOURS)
def stream_corrected(i: Inputs) -> DataFrame:
    """Counters that late rows correct; all rows are in them."""
    out, state = work_folder(i.spark, "corrections"), work_folder(i.spark, "etat")
    jobs.count_all_windows(predictions(i), out, state, "ts", ["model_id"], "1 hour", "10 minutes")
    windows = jobs.corrected_windows(i.spark, out, ["model_id"])
    hour = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_seconds(debut))")
    return windows.select(hour.alias("heure"), "model_id", "nb_requetes", "nb_erreurs", "nb_anomalies_dp_manquant")


@query(ROLLING)
def stream_rolling(i: Inputs) -> DataFrame:
    out, tails, state = (work_folder(i.spark, n) for n in ("latence", "queue", "etat"))
    jobs.roll_latency(predictions(i), out, tails, state, ["model_id"], "ts", "event_id", "latence_ms")
    return i.spark.read.parquet(out).select("event_id", "model_id", "fenetre_glissante", "latence_moyenne_ms", "latence_p95_ms")


@query(ALERTS)
def stream_alerts(i: Inputs) -> DataFrame:
    out, state = work_folder(i.spark, "alertes"), work_folder(i.spark, "etat")
    jobs.alert(predictions(i), out, state, "texte", ["event_id", "model_id"])
    return i.spark.read.parquet(out)


def intake(i: Inputs) -> str:
    """Folder of the tables written from arriving reports."""
    out, state = (work_folder(i.spark, n) for n in ("arrivees", "etat"))
    orders = jobs.read_files(stream_session(i.spark), f"{i.folder}/orders*.parquet", i.table("orders").schema)
    orders = orders.unionByName(orders.where("o_orderkey % 4 = 0"))  # a fourth of the reports is delivered twice
    known = F.concat(F.lit("C"), F.lpad((F.col("o_orderkey") % 3).cast("string"), 5, "0"))
    code = F.when(F.col("o_orderkey") % 7 == 2, F.lit("ZZ99")).otherwise(known)
    diagnoses = F.array(
        F.struct(F.lit("DP").alias("type_diag"), code.alias("code_cim11")),
        F.struct(F.lit("DAS").alias("type_diag"), F.lit("C00001").alias("code_cim11")))
    arriving = orders.select(F.col("o_orderkey").alias("id_crh"), F.col("o_custkey").alias("id_sejour"), diagnoses.alias("diagnostics"))
    session = arriving.sparkSession
    customer = session.read.parquet(f"{i.folder}/customer.parquet")
    stays = customer.where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("id_sejour"))
    stays = stays.unionByName(stays.where("id_sejour % 2 = 0"))  # half of the stays are listed twice
    part = session.read.parquet(f"{i.folder}/part.parquet")
    codes = part.select(F.concat(F.lit("C"), F.lpad(F.col("p_partkey").cast("string"), 5, "0")).alias("code"), F.col("p_name").alias("libelle"))
    jobs.take_in(arriving, out, state, stays, codes)
    return out


@query("""SELECT o_orderkey AS id_crh, CASE WHEN o_custkey % 10 = 3 THEN 'sejour inconnu' WHEN o_orderkey % 7 = 2 THEN 'code inconnu : ZZ99' END AS motif
    FROM orders""")
def stream_intake(i: Inputs) -> DataFrame:
    out = intake(i)
    kept = i.spark.read.parquet(f"{out}/crh").select("id_crh", F.lit(None).cast("string").alias("motif"))
    return kept.unionByName(i.spark.read.parquet(f"{out}/refus").select("id_crh", "motif"))


@query("SELECT o_orderkey AS id_crh, 'reçu deux fois dans le lot' AS motif FROM orders WHERE o_orderkey % 4 = 0")
def stream_repeats(i: Inputs) -> DataFrame:
    return i.spark.read.parquet(f"{intake(i)}/rejoues").select("id_crh", "motif")


@query("""SELECT d.id_crh, d.type_diag, d.code_cim11, p.p_name AS libelle_saisi FROM (
      SELECT o_orderkey AS id_crh, 'DP' AS type_diag, o_orderkey % 3 AS k, 'C0000' || (o_orderkey % 3) AS code_cim11 FROM orders WHERE o_custkey % 10 <> 3 AND o_orderkey % 7 <> 2
      UNION ALL SELECT o_orderkey, 'DAS', 1, 'C00001' FROM orders WHERE o_custkey % 10 <> 3 AND o_orderkey % 7 <> 2) d
    JOIN part p ON p.p_partkey = d.k""")
def stream_diagnoses(i: Inputs) -> DataFrame:
    return i.spark.read.parquet(f"{intake(i)}/diagnostic").select("id_crh", "type_diag", "code_cim11", "libelle_saisi")
