import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from nosoflow.operators import lookup
from nosoflow.operators.scoring import score_reports
from nosoflow.operators.stays import stay_length
from nosoflow.sources import readers, writers


def test_csv_quotes_newlines_and_bom(spark, tmp_path):
    path = tmp_path / "syn.csv"
    path.write_text('﻿code;synonyme;source\nA00;"choléra\nclassique";s1\nB00;"dit ""herpès""";s2\n', encoding="utf-8")
    rows = readers.read_csv(spark, str(path), readers.SYNONYMS_CSV, ";").collect()
    assert [tuple(r) for r in rows] == [("A00", "choléra\nclassique", "s1"), ("B00", 'dit "herpès"', "s2")]
    back = str(tmp_path / "back")
    writers.write_csv(readers.read_csv(spark, str(path), readers.SYNONYMS_CSV, ";"), back, ";", bom=True)
    assert [tuple(r) for r in readers.read_csv(spark, back, readers.SYNONYMS_CSV, ";").collect()] == [tuple(r) for r in rows]


@pytest.fixture
def small_splits(spark):
    """Files are read in blocks of some hundred bytes."""
    settings = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1b"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_quoted_newlines_are_read_by_many_tasks(spark, tmp_path, small_splits, ending):
    """Rows and order equal the reader that takes a file whole: quoted newlines, separators and quotes, long values over several blocks, blank lines, empty values."""
    rnd = random.Random(5)
    folder = tmp_path / "csv"
    folder.mkdir()

    def value():
        text = "".join(rnd.choice(["a", "b c", ";", '"', ending, "é", ""]) for _ in range(rnd.randrange(6))) + ("x" * 700 + ending + "y" if rnd.random() < 0.03 else "")
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in ';"\n') or rnd.random() < 0.2 else text

    for name, rows in (("a", 150), ("b", 40), ("c", 0)):
        lines = ["code;synonyme;source"] + [f"K{i:04d};{value()};{value()}" + ("" if rnd.random() < 0.9 else ending) for i in range(rows)]
        (folder / f"{name}.csv").write_bytes(("\ufeff" * (name == "b") + ending.join(lines) + (ending if name != "a" else "")).encode())
    whole = readers.with_file_order(readers.read_csv(spark, str(folder), readers.SYNONYMS_CSV, ";")).orderBy("ord").drop("ord")
    split = readers.read_quoted_csv(spark, str(folder), readers.SYNONYMS_CSV, ";")
    assert readers.read_lines(spark, str(folder), "\n").rdd.getNumPartitions() > 20
    got = [tuple(r) for r in split.orderBy("ord").drop("ord").collect()]
    assert got == [tuple(r) for r in whole.collect()] and len(got) == 190
    assert split.columns == ["code", "synonyme", "source", "ord"]


def test_lines_of_quoted_files_are_not_shuffled(spark, tmp_path, small_splits):
    """Many records, batches of a few rows: only what crosses the border of a block goes through an exchange, and the rows are whole."""
    folder = str(tmp_path / "csv")
    rows = spark.range(0, 3000, 1, 3).selectExpr("concat('K', id) AS code", "IF(id % 3 = 0, NULL, concat('a\n\"', id, '\"; \n\nb')) AS synonyme", "'s' AS source")
    writers.write_csv(rows, folder, ";", bom=True)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        split = readers.read_quoted_csv(spark, folder, readers.SYNONYMS_CSV, ";").drop("ord")
        assert sorted(map(str, split.collect())) == sorted(map(str, rows.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    exchanges = [x for x in split._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x and "Broadcast" not in x]
    assert exchanges and not any("_block" in x or "ligne" in x for x in exchanges)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "MapInArrow" in plan


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    path = tmp_path / "lines"
    path.mkdir()
    texts = {"a.jsonl": [f"a{i}" for i in range(500)], "b.jsonl": [f"b{i}" for i in range(70)]}
    for name, lines in texts.items():
        (path / name).write_text("\n".join(lines) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, "400b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    lines = readers.read_lines(spark, str(path))
    assert lines.rdd.getNumPartitions() > 3
    got = [(r.num, r.brut) for r in readers.number_lines(lines, 1).orderBy("num").collect()]
    spark.conf.unset(key)
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == list(enumerate(texts["a.jsonl"] + texts["b.jsonl"], 1))


def test_parts_are_tagged(spark):
    a = spark.createDataFrame([("x", 1)], "c string, n int")
    got = readers.union_parts({"premier": a, "second": a.withColumn("extra", F.lit(1))}, ["c", "n"])
    assert sorted((r.source, r._part) for r in got.collect()) == [("premier", 0), ("second", 1)]


def test_runs_manifest_and_small_files(spark, tmp_path):
    base = str(tmp_path / "runs")
    moment = dt.datetime(2025, 1, 2, 3, 4, 5)
    units = spark.range(10).selectExpr("cast(id as string) AS cle")
    folder = writers.write_run(units, base, moment)
    assert folder.endswith("run_id=20250102_030405") and spark.read.parquet(base).where("run_id = '20250102_030405'").count() == 10
    with pytest.raises(Exception):
        writers.write_run(units, base, moment)
    manifest = str(tmp_path / "manifest")
    writers.record_finished(units.where("cle < '4'"), manifest, "cle")
    writers.record_finished(units.where("cle = '7'"), manifest, "cle")
    left = lookup.remaining(units, writers.read_manifest(spark, manifest, "cle string, fini_le timestamp"), "cle")
    assert sorted(r.cle for r in left.collect()) == ["4", "5", "6", "8", "9"]
    writers.write_small_csv(units, str(tmp_path / "top"), [F.desc("cle")], 3)
    files = list((tmp_path / "top").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().split() == ["cle", "9", "8", "7"]
    writers.write_lines(units, str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).count() == 10


def test_parquet_renames(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(str(tmp_path / "p"))
    assert readers.read_parquet(spark, str(tmp_path / "p"), {"a": "age", "z": "q"}).columns == ["age", "b"]


def test_stay_length(spark):
    df = spark.createDataFrame([("01/02/2024", "03/02/2024", 2), ("28/02/2024", "01/03/2024", 3), ("x", "01/03/2024", 1)], "e string, s string, los int")
    assert [(r.duree, r.coherent) for r in stay_length(df, "e", "s", "los").collect()] == [(2, True), (2, False), (None, False)]


def test_scorer_runs_per_batch(spark):
    df = spark.createDataFrame([(1, "toux"), (2, "rien")], "id bigint, t string")

    def make():
        return lambda texts: texts.map(lambda t: "DP : Toux (MD12)" if t == "toux" else "aucun")

    got = {r.id: (r.dp.code if r.dp else None, r.das, r.modele) for r in score_reports(df, "id", "t", make, "essai").collect()}
    assert got == {1: ("MD12", [], "essai"), 2: (None, [], "essai")}


def test_each_report_has_its_own_latency(spark):
    def make():
        import time

        def score(texts):
            time.sleep(0.2 if "lent" in set(texts) else 0.0)
            return texts.map(lambda t: "aucun")

        return score

    df = spark.createDataFrame([(i, "lent" if i == 3 else "vite") for i in range(6)], "id int, t string").coalesce(1)
    alone = {r.id: r.latence_ms for r in score_reports(df, "id", "t", make, "essai").collect()}
    assert alone[3] >= 200 and all(v < 150 for i, v in alone.items() if i != 3)
    together = [r.latence_ms for r in score_reports(df, "id", "t", make, "essai", 6).collect()]
    assert len(set(together)) == 1 and together[0] >= 200
