"""Prediction metrics in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nosoflow.operators import monitor
from nosoflow.plans.registry import query
from nosoflow.plans.views import Inputs

COUNTERS = """count(*) AS nb_requetes, count(*) FILTER (is_error) AS nb_erreurs,
  count(*) FILTER (dp_missing AND NOT is_error) AS nb_anomalies_dp_manquant"""
ROLLING = """SELECT event_id, model_id, fenetre_glissante,
      ((CAST(s * 10000 AS HUGEINT) * 20 + 10000 * fenetre_glissante) // (20000 * fenetre_glissante)) / 10.0 AS latence_moyenne_ms,
      CASE WHEN fenetre_glissante >= 5 THEN CAST(round(list_sort(v)[CAST(floor(fenetre_glissante * 0.95::DOUBLE) AS BIGINT)], 1) AS DOUBLE) END AS latence_p95_ms
    FROM (SELECT event_id, model_id, count(*) OVER w AS fenetre_glissante, sum(ms) OVER w AS s, list(ms) OVER w AS v
      FROM (SELECT *, CAST(latence_ms AS DECIMAL(18, 4)) AS ms FROM v_pred WHERE NOT is_error)
      WINDOW w AS (PARTITION BY model_id ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))"""
HOURS = f"""SELECT time_bucket(INTERVAL '1 hour', ts) AS heure, model_id, {COUNTERS} FROM v_pred GROUP BY 1, 2"""
ALERTS = """SELECT event_id, model_id, length(texte) AS longueur_crh, left(sha256(texte), 16) AS empreinte
    FROM v_pred WHERE dp_missing AND NOT is_error"""


@query(f"SELECT model_id, {COUNTERS} FROM v_pred GROUP BY 1")
def monitor_counters(i: Inputs) -> DataFrame:
    return monitor.request_counters(i("v_pred"), ["model_id"])


@query(HOURS)
def hourly_counters(i: Inputs) -> DataFrame:
    zero = F.lit(0)
    hour = F.make_timestamp_ntz(F.year("ts"), F.month("ts"), F.day("ts"), F.hour("ts"), zero, zero)
    return monitor.request_counters(i("v_pred").withColumn("heure", hour), ["heure", "model_id"])


@query(ROLLING)
def rolling_latency(i: Inputs) -> DataFrame:
    rolled = monitor.rolling_latency(i("v_pred"), ["model_id"], "ts", "event_id", "latence_ms")
    return rolled.select("event_id", "model_id", "fenetre_glissante", "latence_moyenne_ms", "latence_p95_ms")


@query("""SELECT model_id, event_id, ts, latence_ms FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM v_pred) WHERE rn <= 50""")
def latest_points(i: Inputs) -> DataFrame:
    return monitor.latest_points(i("v_pred"), ["model_id"], "ts", "event_id").select("model_id", "event_id", "ts", "latence_ms")


@query(f"""WITH hours AS ({HOURS}) SELECT model_id, heure, nb_requetes FROM (
    SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY heure DESC) AS rn FROM hours) WHERE rn <= 50""")
def latest_hours(i: Inputs) -> DataFrame:
    """Latest points of the hourly counters, as shown on a dashboard."""
    hours = hourly_counters(i)
    return monitor.latest_points(hours, ["model_id"], "heure", "nb_requetes").select("model_id", "heure", "nb_requetes")


@query(ALERTS)
def anomaly_log(i: Inputs) -> DataFrame:
    return monitor.anomaly_log(i("v_pred"), "texte", ["event_id", "model_id"])
