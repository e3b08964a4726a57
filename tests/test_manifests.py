import pytest
from pyspark.sql import functions as F

from nosoflow.operators import quality
from nosoflow.sources import manifests

SCHEMAS = {"patient_fictif": "id_patient bigint, nom string", "sejour": "id_sejour bigint, id_patient bigint", "crh": "id_crh bigint, id_sejour bigint", "diagnostic": "id_crh bigint, code string"}


@pytest.fixture
def tables(spark):
    """Forty patients in ten files, two stays each, reports of stays, diagnoses of reports; ids in ranges, so a patient is in few files."""
    patients = spark.range(0, 40, 1, 10).select(F.col("id").alias("id_patient"), F.concat(F.lit("p"), "id").alias("nom"))
    stays = spark.range(0, 80, 1, 10).select(F.col("id").alias("id_sejour"), F.floor(F.col("id") / 2).cast("bigint").alias("id_patient"))
    reports = spark.range(0, 160, 1, 10).select(F.col("id").alias("id_crh"), F.floor(F.col("id") / 2).cast("bigint").alias("id_sejour"))
    diagnoses = spark.range(0, 480, 1, 10).select(F.floor(F.col("id") / 3).cast("bigint").alias("id_crh"), F.concat(F.lit("C"), "id").alias("code"))
    return {"patient_fictif": patients, "sejour": stays, "crh": reports, "diagnostic": diagnoses}


def rows(frames):
    return {name: sorted(map(tuple, frame.collect())) for name, frame in frames.items()}


def current(spark, base, version=None):
    return rows({name: manifests.read(spark, base, name, schema, version) for name, schema in SCHEMAS.items()})


def test_one_patient_costs_the_files_it_is_in(spark, tables, tmp_path):
    base = f"file://{tmp_path}/base"
    manifests.create(tables, base)
    before = current(spark, base)
    assert before == rows(tables)
    erased = spark.createDataFrame([(13,), (13,)], "id_patient bigint")
    assert manifests.erase_patients(spark, base, erased, SCHEMAS) == {"patient_fictif": 1, "sejour": 1, "crh": 1, "diagnostic": 1}
    want = quality.erase_patients(erased, tables["patient_fictif"], tables["sejour"], tables["crh"], tables["diagnostic"])
    assert current(spark, base) == rows(want) and current(spark, base, 0) == before
    taken_over = manifests.files(spark, base, 0).join(manifests.files(spark, base), ["nom", "fichier"]).groupBy("nom").count().collect()
    assert {r.nom: r["count"] for r in taken_over} == dict.fromkeys(SCHEMAS, 9)


def test_nobody_hit_is_no_new_version_and_all_hit_leaves_empty_tables(spark, tables, tmp_path):
    base = f"file://{tmp_path}/base"
    manifests.create(tables, base)
    assert set(manifests.erase_patients(spark, base, spark.createDataFrame([(99,)], "id_patient bigint"), SCHEMAS).values()) == {0}
    assert manifests.versions(spark, base) == [0]
    manifests.erase_patients(spark, base, tables["patient_fictif"], SCHEMAS)
    assert current(spark, base) == dict.fromkeys(SCHEMAS, [])
    with pytest.raises(FileNotFoundError):
        manifests.files(spark, f"{base}/nothing")


def test_a_lost_driver_changes_nothing_and_is_rolled_back(spark, tables, tmp_path, monkeypatch):
    base = f"file://{tmp_path}/base"
    manifests.create(tables, base)
    before = current(spark, base)
    monkeypatch.setattr(manifests, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        manifests.erase_patients(spark, base, spark.createDataFrame([(5,)], "id_patient bigint"), SCHEMAS)
    monkeypatch.undo()
    (tmp_path / "base" / "manifest" / "v=1").mkdir()  # a version that was not written to its end
    assert current(spark, base) == before and manifests.versions(spark, base) == [0]
    assert manifests.roll_back(spark, base) == 5
    assert current(spark, base) == before and manifests.roll_back(spark, base) == 0
    manifests.erase_patients(spark, base, spark.createDataFrame([(5,)], "id_patient bigint"), SCHEMAS)
    assert manifests.versions(spark, base) == [0, 1]


def test_a_version_is_written_once(spark, tables, tmp_path):
    base = f"file://{tmp_path}/base"
    manifests.create(tables, base)
    with pytest.raises(Exception, match="(?i)already exists"):
        manifests.create(tables, base)
