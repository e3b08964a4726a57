import json

import pytest
from pyspark.sql import functions as F

from nosoflow.operators import evaluate, quality, reports


def example(report="Patient admis pour une toux fébrile.", reply="DP : Toux (MD12)\nDAS : aucun", roles=("system", "user", "assistant")):
    contents = {"system": "consigne", "user": report, "assistant": reply}
    return json.dumps({"messages": [{"role": r, "content": contents[r]} for r in roles]}, ensure_ascii=False)


def errors(spark, lines, minimum=0):
    df = spark.createDataFrame(list(enumerate(lines, 1)), "num bigint, brut string")
    return sorted((r.num or 0, r.regle) for r in quality.corpus_errors(reports.parse_examples(df), minimum).collect())


@pytest.mark.parametrize("line,rules", [
    (example(), []),
    ("   ", []),
    ('{"messages": [ceci n\'est pas du JSON}', ["R1"]),
    ('{"autre": []}', ["R1"]),
    ("[1]", ["R1"]),
    (example(roles=("user", "assistant")), ["R2"]),
    (example(roles=("user", "system", "assistant")), ["R2"]),
    ('{"messages": 3}', ["R2"]),
    (example("  court \n"), ["R3"]),
    (example(reply="rien"), ["R4"]),
    (example("court", "rien"), ["R3", "R4"]),
])
def test_rules(spark, line, rules):
    assert [r for _, r in errors(spark, [line])] == rules


def test_copies_and_size(spark):
    lines = [example("court"), example(" court"), example(), "x", example(), example("Patient admis pour une toux fébrile. ")]
    assert errors(spark, lines, 7) == [(0, "MIN"), (1, "R3"), (2, "R3"), (2, "R5"), (4, "R1"), (5, "R5"), (6, "R5")]


def test_summary(spark):
    df = spark.createDataFrame([(1, example()), (2, "")], "num bigint, brut string")
    examples = reports.parse_examples(df)
    assert tuple(quality.corpus_summary(examples, quality.corpus_errors(examples)).first()) == (1, 0, True)


@pytest.mark.parametrize("f1,em,base,n", [(0.737, 0.667, 0.53, 0), (0.42, 0.30, 0.3, 2), (0.72, 0.65, 0.72, 1)])
def test_metric_gate(spark, f1, em, base, n):
    rows = [("m", "finetuned", "souple", "f1", f1), ("m", "finetuned", "souple", "exact_match", em), ("m", "base", "souple", "f1", base),
            ("m", "finetuned", "strict", "f1", 0.1)]
    df = spark.createDataFrame(rows, "modele string, variante string, mode string, metrique string, valeur double")
    row = quality.metric_gate(df).first()
    assert row.valide == (n == 0) and len([e for e in row.erreurs.split(" ; ") if e]) == n


@pytest.mark.parametrize("left_out", range(3))
def test_the_gate_stays_shut_without_a_metric(spark, left_out):
    rows = [("m", "finetuned", "souple", "f1", 0.9), ("m", "finetuned", "souple", "exact_match", 0.9), ("m", "base", "souple", "f1", 0.1)]
    schema = "modele string, variante string, mode string, metrique string, valeur double"
    row = quality.metric_gate(spark.createDataFrame(rows[:left_out] + rows[left_out + 1:], schema)).first()
    assert not row.valide and "absente" in row.erreurs
    rows[left_out] = (*rows[left_out][:4], None)
    assert not quality.metric_gate(spark.createDataFrame(rows, schema)).first().valide


def test_constraints(spark):
    df = spark.createDataFrame([(1, "1", "ab"), (2, "3", "abc"), (3, None, None), (3, "9", "a")], "id int, sexe string, nom string")
    assert [r.cle for r in quality.value_violations(df, "id", "sexe", ["1", "2", "9"], "patient").collect()] == ["2"]
    assert [tuple(r) for r in quality.key_duplicates(df, ["id"], "patient").collect()] == [("patient", "3", 2)]
    assert {r.column_name: r.n for r in quality.required_nulls(df, ["id", "nom"], "p").collect()} == {"id": 0, "nom": 1}
    assert [(r.cle, r.longueur) for r in quality.length_violations(df, "id", {"nom": 2, "sexe": 1}, "p").collect()] == [("2", 3)]
    parents = spark.createDataFrame([("1",), ("9",)], "s string")
    assert [r.reference for r in quality.reference_violations(df, "id", "sexe", parents, "s", "l").collect()] == ["3"]


def test_erasure(spark):
    patients = spark.createDataFrame([(1,), (2,)], "id_patient int")
    stays = spark.createDataFrame([(10, 1), (20, 2)], "id_sejour int, id_patient int")
    crh = spark.createDataFrame([(100, 10), (200, 20)], "id_crh int, id_sejour int")
    diag = spark.createDataFrame([(100, "A"), (200, "B")], "id_crh int, code_cim11 string")
    kept = quality.erase_patients(patients.where("id_patient = 1"), patients, stays, crh, diag)
    assert [kept["patient_fictif"].first().id_patient, kept["sejour"].first().id_sejour, kept["crh"].first().id_crh] == [2, 20, 200]
    assert [r.code_cim11 for r in kept["diagnostic"].collect()] == ["B"] and kept["crh"].count() == 1
    codes = spark.createDataFrame([("A",), ("B",), ("C",)], "code string")
    pc = spark.createDataFrame([("A", "A&X"), ("C", "C&X")], "code_racine string, code_postcoord string")
    left = quality.erase_codes(codes, codes, diag, {"pc": (pc, "code_racine")})
    assert sorted(r.code for r in left["code_cim11"].collect()) == ["A", "B"] and left["pc"].count() == 1


def test_empty_output_fails(spark):
    df = spark.range(3)
    assert quality.non_empty(df, "vide").count() == 3
    with pytest.raises(Exception, match="page vide"):
        quality.non_empty(df.where("id > 5"), "page vide").collect()


def test_intake(spark):
    new = spark.createDataFrame([(1, 10), (2, 99), (3, 10), (4, 10)], "id_crh int, id_sejour int")
    diag = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (3, "Q")], "id_crh int, code_cim11 string")
    checked = reports.check_intake(new, diag, spark.createDataFrame([(10,)], "id_sejour int"), spark.createDataFrame([("A",)], "code string"))
    assert {r.id_crh: r.motif for r in checked.collect()} == {1: None, 2: "sejour inconnu", 3: "code inconnu : Q", 4: None}
    assert [r.id_crh for r in reports.accepted_diagnostics(checked, diag).collect()] == [1]


def test_metrics(spark):
    expected = spark.createDataFrame([(1, "A"), (1, "B&X"), (2, "C"), (3, "D")], "id int, code string")
    found = spark.createDataFrame([(1, "A"), (1, "B&Y"), (2, "C"), (2, "C")], "id int, code string")
    rows = evaluate.code_metrics(expected, {"a": found, "b": expected}).collect()
    strict = {r.metrique: r.valeur for r in rows if (r.variante, r.mode) == ("a", "strict")}
    assert strict == {"precision": 0.6667, "recall": 0.5, "f1": 0.5714, "exact_match": 0.3333}
    lenient = {r.metrique: r.valeur for r in rows if (r.variante, r.mode) == ("a", "souple")}
    assert {r.valeur for r in rows if r.variante == "b"} == {1.0}
    assert lenient == {"precision": 1.0, "recall": 0.75, "f1": 0.8571, "exact_match": 0.6667}


def test_evaluation_set_and_agreement(spark):
    crh = spark.createDataFrame([(1, "x" * 30), (2, "x" * 20), (3, "x" * 25), (4, "x" * 5)], "id_crh int, texte_crh string")
    diag = spark.createDataFrame([(1, "DP", "A"), (2, "DP", "A"), (3, "DP", "B"), (4, "DP", "C"), (3, "DAS", "D")], "id_crh int, type_diag string, code_cim11 string")
    codes = spark.createDataFrame([("A", "Fièvre")], "code string, libelle string")
    cases = evaluate.evaluation_set(crh, diag, codes, 10, 20, 40)
    assert [(r.id_crh, r.code_dp) for r in cases.orderBy("longueur").collect()] == [(3, "B"), (1, "A")]
    answers = spark.createDataFrame([(1, "a&X", "Grosse FIEVRE"), (3, None, None)], "id_crh int, code_predit string, libelle_predit string")
    judged = evaluate.agreement(cases.join(answers, "id_crh"))
    assert tuple(evaluate.agreement_counts(judged).first()) == (2, 1, 0, 1, 1)


def test_length_gate(spark):
    df = spark.createDataFrame([("   court   ",), ("assez long ici",), ("x" * 20_001,)], "t string")
    assert reports.length_gate(df, "t").count() == 1


def test_report_tables(spark):
    df = spark.createDataFrame([(0, example(reply="DP : Toux (MD12)\nDAS : Fièvre (MG26)"))], "num bigint, brut string")
    rows = reports.example_reports(reports.parse_examples(df))
    codes = spark.createDataFrame([("MD12",)], "code string")
    assert [(r.type_diag, r.code_cim11) for r in reports.load_diagnostics(rows, codes).collect()] == [("DP", "MD12")]
    assert tuple(reports.load_counts(rows, codes).first()) == (1, 1, 1)
    assert reports.synthetic_patients(rows).first().nom == "Fictif0"
    assert reports.report_table(rows).where(F.col("date_redaction").isNull()).count() == 0


def test_a_large_parent_is_cut_to_the_keys_of_a_small_child(spark, tmp_path):
    """Only keys that the child asks for are shuffled or sorted; the rows are those of the plain anti join."""
    spark.range(200_000).selectExpr("id * 2 AS p").write.parquet(str(tmp_path / "parent"))
    spark.range(300).selectExpr("id AS k", "IF(id % 10 = 0, NULL, id % 50) AS r").write.parquet(str(tmp_path / "child"))
    parent, child = spark.read.parquet(str(tmp_path / "parent")), spark.read.parquet(str(tmp_path / "child"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "100k")
    missing = quality.reference_violations(child, "k", "r", parent, "p", "child.r")
    got = sorted(map(tuple, missing.collect()))
    plan = missing._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(key, before)
    assert got == sorted(("child.r", str(k), str(k % 50)) for k in range(300) if k % 10 and k % 2)
    assert "LeftSemi" in plan and plan.index("Exchange") > 0 and "BroadcastHashJoin" in plan
