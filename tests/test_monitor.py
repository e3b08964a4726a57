import datetime as dt
import hashlib
import random
from collections import deque
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from nosoflow.operators import monitor
from nosoflow.operators.scaling import ordinals
from nosoflow.streaming import jobs

SCHEMA = "event_id bigint, ts timestamp, model_id bigint, latence_ms double, is_error boolean, dp_missing boolean, texte string"
START = dt.datetime(2024, 1, 1)


def one_decimal(x):
    return float(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_UP))


def events(n, seed=0, first=0, minute=0):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        model = 1 if rnd.random() < 0.5 else rnd.randrange(2, 6)
        ts = START + dt.timedelta(minutes=minute, seconds=rnd.randrange(3600))
        rows.append((first + k, ts, model, round(rnd.random() * 500, 2), rnd.random() < 0.1, rnd.random() < 0.05, f"texte {k}"))
    return rows


def expected_rolling(batches, window=200):
    """Arrival order: batch by batch, by time inside a batch."""
    windows, out = {}, {}
    for rows in batches:
        for r in sorted(rows, key=lambda r: (r[1], r[0])):
            if r[4]:
                continue
            q = windows.setdefault(r[2], deque(maxlen=window))
            q.append(Decimal(str(r[3])))
            p95 = one_decimal(sorted(q)[int(len(q) * 0.95) - 1]) if len(q) >= 5 else None
            out[r[0]] = (len(q), one_decimal(sum(q) / len(q)), p95)
    return out


def test_rolling_equals_a_deque(spark):
    rows = events(1500)
    df = spark.createDataFrame(rows, SCHEMA)
    got = monitor.rolling_latency(df, ["model_id"], "ts", "event_id", "latence_ms").collect()
    assert {r.event_id: (r.fenetre_glissante, r.latence_moyenne_ms, r.latence_p95_ms) for r in got} == expected_rolling([rows])


def test_rolling_in_small_chunks(spark):
    rows = events(900, 3)
    df = spark.createDataFrame(rows, SCHEMA).where("NOT is_error").withColumn("_ms", monitor.exact_latency(F.col("latence_ms")))
    numbered = ordinals(df, ["ts", "event_id"], monitor.minutes(df, "ts"), by=["model_id"], name="position")
    got = monitor.finish_rolling(monitor.sliding(numbered, ["model_id"], "position", 30, chunk=40)).collect()
    assert {r.event_id: (r.fenetre_glissante, r.latence_moyenne_ms, r.latence_p95_ms) for r in got} == expected_rolling([rows], 30)


def test_null_latencies_take_a_place_and_no_part(spark):
    rows = [(k, START + dt.timedelta(seconds=k), 1, None if k % 3 == 0 else float(k), False, False, "t") for k in range(40)]
    got = monitor.rolling_latency(spark.createDataFrame(rows, SCHEMA), ["model_id"], "ts", "event_id", "latence_ms", 9).collect()
    for r in got:
        window = sorted(Decimal(k) for k in range(max(0, r.event_id - 8), r.event_id + 1) if k % 3)
        assert r.fenetre_glissante == len(window)
        assert r.latence_moyenne_ms == (one_decimal(sum(window) / len(window)) if window else None)
        assert r.latence_p95_ms == (one_decimal(window[int(len(window) * 0.95) - 1]) if len(window) >= 5 else None)


def test_counters_and_latest(spark):
    rows = events(400, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    total = monitor.request_counters(df, []).first()
    assert tuple(total) == (400, sum(r[4] for r in rows), sum(r[5] and not r[4] for r in rows))
    last = monitor.latest_points(df, ["model_id"], "ts", "event_id", 3).collect()
    for model in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == model), key=lambda r: (r[1], r[0]))[-3:]
        assert {r.event_id for r in last if r.model_id == model} == {r[0] for r in mine}


def test_anomaly_log_has_no_text(spark):
    secret = "Mme Untel, née le 2 mai, Lyon"
    df = spark.createDataFrame([(1, START, 1, 1.0, False, True, secret), (2, START, 1, 1.0, True, True, secret)], SCHEMA)
    row = monitor.anomaly_log(df, "texte", ["event_id"]).collect()
    assert [tuple(r) for r in row] == [(1, len(secret), hashlib.sha256(secret.encode()).hexdigest()[:16])]


def write(spark, rows, folder, number):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={number}")


@pytest.fixture
def folders(tmp_path):
    return {n: str(tmp_path / n) for n in ("in", "out", "tails", "state", "intake")}


def source(spark, folders):
    schema = spark.createDataFrame([], SCHEMA).schema
    return jobs.read_files(spark, folders["in"], schema, 1)


def test_stream_rolls_across_batches(spark, folders):
    batches = [events(300, 5), events(300, 6, 1000, 30), events(200, 7, 2000, 10)]
    for k, rows in enumerate(batches):  # the third batch is older than the second: it counts on arrival
        write(spark, rows, folders["in"], k)
        jobs.roll_latency(source(spark, folders), folders["out"], folders["tails"], folders["state"], ["model_id"], "ts", "event_id", "latence_ms", 50)
    got = spark.read.parquet(folders["out"]).collect()
    assert {r.event_id: (r.fenetre_glissante, r.latence_moyenne_ms, r.latence_p95_ms) for r in got} == expected_rolling(batches, 50)


def test_stream_windows_update_and_drop_late_rows(spark, folders):
    early = [(1, START, 1, 1.0, False, False, "t"), (2, START + dt.timedelta(minutes=5), 1, 1.0, True, False, "t")]
    later = [(3, START + dt.timedelta(minutes=50), 1, 1.0, False, True, "t"), (4, START + dt.timedelta(hours=3), 1, 1.0, False, False, "t")]
    late = [(5, START + dt.timedelta(minutes=1), 1, 1.0, False, False, "t"), (6, START + dt.timedelta(hours=3), 2, 1.0, False, False, "t")]
    for k, rows in enumerate([early, later, late]):
        write(spark, rows, folders["in"], k)
        jobs.count_windows(source(spark, folders), folders["out"], folders["state"], "ts", ["model_id"], "1 hour", "10 minutes")
    got = jobs.latest_windows(spark, folders["out"], ["model_id"]).collect()
    counts = {(r.debut.hour, r.model_id): (r.nb_requetes, r.nb_erreurs, r.nb_anomalies_dp_manquant) for r in got}
    assert counts == {(0, 1): (3, 1, 1), (3, 1): (1, 0, 0), (3, 2): (1, 0, 0)}


def test_alerts_resume_without_repeating(spark, folders):
    for k in range(2):
        write(spark, events(200, k, 1000 * k), folders["in"], k)
        jobs.alert(source(spark, folders), folders["out"], folders["state"], "texte", ["event_id"])
    jobs.alert(source(spark, folders), folders["out"], folders["state"], "texte", ["event_id"])
    wanted = sorted(r[0] for k in range(2) for r in events(200, k, 1000 * k) if r[5] and not r[4])
    assert sorted(r.event_id for r in spark.read.parquet(folders["out"]).collect()) == wanted


def test_intake_stream(spark, folders):
    schema = "id_crh int, id_sejour int, diagnostics array<struct<type_diag:string,code_cim11:string>>"
    rows = [(1, 10, [("DP", "A")]), (2, 10, [("DP", "A"), ("DAS", "Q")]), (3, 11, [("DP", "A")]), (4, 10, [])]
    for k in range(2):
        spark.createDataFrame(rows[2 * k:2 * k + 2], schema).coalesce(1).write.parquet(f"{folders['in']}/part={k}")
    stream = jobs.read_files(spark, folders["in"], spark.createDataFrame([], schema).schema, 1)
    stays, codes = spark.createDataFrame([(10,)], "id_sejour int"), spark.createDataFrame([("A", "Fièvre")], "code string, libelle string")
    jobs.take_in(stream, folders["intake"], folders["state"], stays, codes)
    crh, diag, refused = (spark.read.parquet(f"{folders['intake']}/{n}") for n in ("crh", "diagnostic", "refus"))
    assert sorted(r.id_crh for r in crh.collect()) == [1, 4] and "diagnostics" not in crh.columns
    assert [(r.id_crh, r.type_diag, r.code_cim11, r.libelle_saisi) for r in diag.collect()] == [(1, "DP", "A", "Fièvre")]
    assert {r.id_crh: r.motif for r in refused.collect()} == {2: "code inconnu : Q", 3: "sejour inconnu"}


def test_redelivered_reports_are_taken_in_once(spark, folders):
    """The same file again, a copy within a file, a report that was refused before its stay was known, repeated stays and labels."""
    schema = "id_crh int, id_sejour int, diagnostics array<struct<type_diag:string,code_cim11:string>>"
    first = [(1, 10, [("DP", "A")]), (2, 11, [("DP", "A")]), (1, 10, [("DP", "A")]), (3, 10, [("DP", "Q")])]
    codes = spark.createDataFrame([("A", "Fièvre"), ("A", "Zona")], "code string, libelle string")
    stays = [(10,), (10,)]
    for number, rows in enumerate([first, first, [(2, 11, [("DP", "A")]), (4, 10, [])], [*first, (4, 10, [])]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folders['in']}/part={number}")
        stays += [(11,)] if number == 2 else []
        stream = jobs.read_files(spark, folders["in"], spark.createDataFrame([], schema).schema, 1)
        jobs.take_in(stream, folders["intake"], folders["state"], spark.createDataFrame(stays, "id_sejour int"), codes)
    crh, diag, refused, again = (spark.read.parquet(f"{folders['intake']}/{n}") for n in ("crh", "diagnostic", "refus", "rejoues"))
    assert sorted((r.id_crh, r.lot) for r in crh.collect()) == [(1, 0), (2, 2), (4, 2)]
    assert sorted((r.id_crh, r.libelle_saisi) for r in diag.collect()) == [(1, "Fièvre"), (2, "Fièvre")]
    assert sorted((r.id_crh, r.motif, r.lot) for r in refused.collect()) == [(2, "sejour inconnu", 0), (3, "code inconnu : Q", 0)]
    twice, known = "reçu deux fois dans le lot", "déjà enregistré"
    assert sorted((r.lot, r.id_crh, r.motif) for r in again.collect()) == sorted(
        [(0, 1, twice), (1, 1, twice), (1, 1, known), (3, 1, twice), (3, 1, known), (3, 2, known), (3, 4, known)])


def test_a_report_gives_one_row_however_often_its_stay_is_listed(spark):
    from nosoflow.operators import reports

    rows = spark.createDataFrame([(1, 10), (2, 12)], "id_crh int, id_sejour int")
    diagnoses = spark.createDataFrame([(1, "A"), (1, "A")], "id_crh int, code_cim11 string")
    stays, codes = spark.createDataFrame([(10,), (10,), (10,)], "id_sejour int"), spark.createDataFrame([("A",), ("A",)], "code string")
    got = reports.check_intake(rows, diagnoses, stays, codes)
    assert sorted((r.id_crh, r.motif) for r in got.collect()) == [(1, None), (2, "sejour inconnu")]


def test_late_rows_correct_closed_windows_and_are_listed(spark, folders):
    def at(event, minute, model=1, error=False):
        return (event, START + dt.timedelta(minutes=minute), model, 1.0, error, False, "t")

    batches = [[at(1, 0), at(2, 5, error=True)], [at(3, 50), at(4, 180)], [at(5, 1), at(6, 55, 2), at(7, 181), at(8, 2, error=True)], [at(9, 119)]]
    for k, rows in enumerate(batches):
        write(spark, rows, folders["in"], k)
        jobs.count_all_windows(source(spark, folders), folders["out"], folders["state"], "ts", ["model_id"], "1 hour", "10 minutes")
    got = {(r.debut.hour, r.model_id): (r.nb_requetes, r.nb_erreurs, r.nb_tardives) for r in jobs.corrected_windows(spark, folders["out"], ["model_id"]).collect()}
    assert got == {(0, 1): (5, 2, 2), (0, 2): (1, 0, 1), (1, 1): (1, 0, 1), (3, 1): (2, 0, 0)}
    late = {r.event_id: r.motif for r in spark.read.parquet(f"{folders['out']}/retards").collect()}
    assert set(late) == {5, 6, 8, 9} and all(m.startswith("fenêtre close : 2024-01-01 0") for m in late.values())


def test_the_tail_of_an_idle_model_is_left_alone(spark, folders):
    def run(k, models):
        rows = [(1000 * k + n, START + dt.timedelta(hours=k, seconds=n), models[n % len(models)], float(n), False, False, "t") for n in range(40)]
        write(spark, rows, folders["in"], k)
        jobs.roll_latency(source(spark, folders), folders["out"], folders["tails"], folders["state"], ["model_id"], "ts", "event_id", "latence_ms", 20)
        return rows

    batches = [run(0, [1, 2]), run(1, [2]), run(2, [2]), run(3, [1, 2])]
    written = {r.lot: r.m for r in spark.read.parquet(folders["tails"]).groupBy("lot").agg(F.sort_array(F.collect_set("model_id")).alias("m")).collect()}
    assert written == {0: [1, 2], 1: [2], 2: [2], 3: [1, 2]}
    got = spark.read.parquet(folders["out"]).collect()
    assert {r.event_id: (r.fenetre_glissante, r.latence_moyenne_ms, r.latence_p95_ms) for r in got} == expected_rolling(batches, 20)


def test_groups_of_tails_follow_the_models(spark, folders, monkeypatch):
    """More models, more groups: tails written before are still found, and a group is split when it is touched."""
    monkeypatch.setattr(jobs, "GROUP_MODELS", 2)
    monkeypatch.setattr(jobs, "LEAST_LEVEL", 0)
    batches = []
    for k, models in enumerate([[1, 2], list(range(1, 30)), [3], [1, 2, 29], list(range(20, 40))]):
        rows = [(1000 * k + n, START + dt.timedelta(hours=k, seconds=n), models[n % len(models)], float(n), False, False, "t") for n in range(120)]
        batches.append(rows)
        write(spark, rows, folders["in"], k)
        jobs.roll_latency(source(spark, folders), folders["out"], folders["tails"], folders["state"], ["model_id"], "ts", "event_id", "latence_ms", 9)
    got = spark.read.parquet(folders["out"]).collect()
    assert {r.event_id: (r.fenetre_glissante, r.latence_moyenne_ms, r.latence_p95_ms) for r in got} == expected_rolling(batches, 9)
    groups = {r.lot: {g.split("-")[0] for g in r.g} for r in spark.read.parquet(folders["tails"]).groupBy("lot").agg(F.collect_set("groupe").alias("g")).collect()}
    assert groups == {0: {"0"}, 1: {"4"}, 2: {"4"}, 3: {"4"}, 4: {"4"}}


def test_compacted_windows_are_the_newest(spark, folders):
    write(spark, [(1, START, 1, 1.0, False, False, "t")], folders["in"], 0)
    for k in range(1, 3):
        jobs.count_windows(source(spark, folders), folders["out"], folders["state"], "ts", ["model_id"], "1 hour", "10 minutes")
        write(spark, [(k + 1, START + dt.timedelta(minutes=k), 1, 1.0, False, False, "t")], folders["in"], k)
    jobs.compact_windows(spark, folders["out"], folders["intake"], ["model_id"])
    latest = [jobs.latest_windows(spark, folders[n], ["model_id"]).collect() for n in ("out", "intake")]
    assert latest[0] == latest[1] and latest[0][0].nb_requetes == 2
