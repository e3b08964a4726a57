import json

import pytest
from pyspark.sql import functions as F

from nosoflow.plans import jobs


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_load_then_extract(spark, tmp_path):
    reply = "DP : Choléra (1A00)\nDAS : Autre (9Z99)"
    examples = [json.dumps({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": f"texte {k}"},
                                         {"role": "assistant", "content": reply}]}) for k in range(3)]
    files = jobs.TerminologyFiles(
        terms=put(tmp_path / "t.csv", "﻿code,texte,type,uri\n1A00,Choléra,title,u\n1A00,Peste bleue,indexTerm,u\n2B00,Autre,title,v\n"),
        synonyms=put(tmp_path / "s.csv", 'code;synonyme;source\nA00;"choléra\nvrai";s1\nB00;x;s1\nA00;y;s2\n'),
        icd_map=put(tmp_path / "m.csv", "icd10Code,icd11Code\nA00,9Z99\nA00,1A00\n"),
        postcoord=put(tmp_path / "p.csv", "code_racine,libelle_racine,code_postcoord,libelles_extensions\n1A00,Choléra,1A00&X1,e\n1A00,Choléra,1A00&X1,f\n7Z,q,7Z&X,e\n"),
        axes=put(tmp_path / "a.csv", "code,axe_nom,allow_multiple,taille_axe,raison_arret\n1A00,axe,NotAllowed,,\n"),
        examples=put(tmp_path / "e.jsonl", "\n".join(examples) + "\n"))
    base = str(tmp_path / "base")
    jobs.load_tables(spark, files, base)
    counts = {n: spark.read.parquet(f"{base}/{n}").count() for n in
              ("code_cim11", "synonyme", "code_postcoord", "axe_postcoord", "patient_fictif", "sejour", "crh", "diagnostic")}
    assert counts == {"code_cim11": 2, "synonyme": 2, "code_postcoord": 1, "axe_postcoord": 1, "patient_fictif": 3, "sejour": 3, "crh": 3, "diagnostic": 3}
    jobs.extract_documented_codes(spark, base, str(tmp_path / "doc"))
    lines = next((tmp_path / "doc").glob("*.csv")).read_text(encoding="utf-8").splitlines()
    assert lines == ["code_cim11,libelle,nb_synonymes,nb_postcoord,exemple_crh", "1A00,Choléra,2,1,texte 0"]
    jobs.extract_top_roots(spark, files.postcoord, str(tmp_path / "top"), 1)
    assert next((tmp_path / "top").glob("*.csv")).read_text().split() == ["code_racine,nb_combinaisons_realistes", "1A00,2"]
    assert jobs.validate_corpus(spark, files.examples, 5).orderBy("regle").collect()[0].regle == "MIN"


def test_items_job_fails_on_drift(spark, tmp_path):
    page = '<li class="item-news"><a class="link-news" href="/a"><h4 class="title-news">T</h4></a></li>'
    jobs.extract_items(spark, put(tmp_path / "p.html", page), str(tmp_path / "out"), "https://h")
    written = "".join(f.read_text() for f in (tmp_path / "out").glob("*.csv"))
    assert "https://h/a" in written and "date_iso,date_affichee,titre,chapo,url" in written
    with pytest.raises(Exception, match="structure de page"):
        jobs.extract_items(spark, put(tmp_path / "q.html", "<p>refondu</p>"), str(tmp_path / "out2"), "https://h")
    assert [r.erreur for r in spark.read.csv(str(tmp_path / "out2_ecarts"), header=True).collect()] == ["structure de page non reconnue"]
    assert spark.read.csv(str(tmp_path / "out_ecarts"), schema="page string, erreur string", header=True).collect() == []


def test_dictionary_job(spark, tmp_path):
    a = spark.createDataFrame([("A", "toux", 0), ("Z1", "bilan", 1)], "code string, synonyme string, ord int")
    b = spark.createDataFrame([("B", "toux", 0)], "code string, synonyme string, ord int")
    jobs.build_dictionary({"un": a, "deux": b}, str(tmp_path / "d"))
    text = "".join(f.read_text(encoding="utf-8") for f in sorted((tmp_path / "d").glob("*.csv")))
    assert "A;toux;un / deux" in text and "bilan" not in text


def test_verify_job(spark, tmp_path):
    line = json.dumps({"custom_id": "A1", "response": {"body": {"choices": [{"message": {"content": "A1&X1 A1&X9"}}]}}})
    (tmp_path / "b").mkdir()
    put(tmp_path / "b" / "batch_0000.jsonl", line + "\n{coupé\n")
    roots = spark.createDataFrame([("A1", "un")], "code string, libelle string")
    ext = spark.createDataFrame([("X1", "gauche")], "code string, libelle string")
    jobs.verify_responses(spark, str(tmp_path / "b"), roots, ext, str(tmp_path / "v"))
    assert spark.read.csv(str(tmp_path / "v" / "codes"), header=True).first()[:] == ("A1", "un", "A1&X1", "X1 : gauche")
    assert spark.read.csv(str(tmp_path / "v" / "rejets"), header=True).first()[:] == ("A1", "A1&X9", "X9")


def test_count_job(spark, tmp_path):
    def node(uri, code=None, child=(), parent=(), scale=()):
        return json.dumps({"uri": f"http://h/{uri}", "code": code, "title": {"@value": f"t{uri}"}, "child": [f"http://h/{c}" for c in child],
                           "parent": [f"http://h/{p}" for p in parent], "postcoordinationScale": list(scale)})

    axis = [{"axisName": "http://s/a", "scaleEntity": ["http://h/x"]}, {"axisName": "http://s/b", "scaleEntity": ["http://h/x2"]}]
    docs = [node("root", child=["c1", "x"]), node("c1", child=["r", "s"], parent=["root"]), node("r", "A1", parent=["c1"], scale=axis),
            node("s", "A2", parent=["c1"]), node("x", None, ["x1", "x2", "x3"], ["root"]), node("x1", "X1", parent=["x"]), node("x2", "X2", parent=["x"]),
            node("x3", "X3", parent=["x"])]
    titles = spark.createDataFrame([("A1", "http://h/r"), ("A2", "http://h/s"), ("A2", "http://h/s")], "code string, uri string")
    path = put(tmp_path / "n.json", "\n".join(docs))
    jobs.count_postcoordination(spark, path, titles, "https://h/root", str(tmp_path / "o"))
    rows = sorted((r.code, r.chapitre, r.nb_axes, r.nb_couples, int(r.nb_combinaisons)) for r in spark.read.parquet(str(tmp_path / "o" / "par_code")).collect())
    assert rows == [("A1", "01 - tc1", 2, 3, 7), ("A2", "01 - tc1", 0, 0, 0)]
    jobs.count_postcoordination(spark, path, titles, "https://h/root", str(tmp_path / "o2"), 2)
    assert [r.code for r in spark.read.parquet(str(tmp_path / "o2" / "impossibles")).collect()] == ["A1"]


def test_prompt_job(spark, tmp_path):
    profiles = spark.createDataFrame([(i, "A00" if i % 2 else "Q99", "B00,A00" if i % 3 else None, 1 + i % 4) for i in range(40)], "id bigint, icd10_raw string, icd10_sec string, nb int")
    mapping = spark.createDataFrame([("A00", "1A00"), ("B00", "1F00")], "icd10_norm string, icd11 string")
    postcoord = spark.createDataFrame([("1A00", f"1A00&X{k}") for k in range(4)], "code_racine string, code_postcoord string")
    labels = spark.createDataFrame([(f"1A00&X{k}", f"forme {k}") for k in range(4)], "code_postcoord string, libelle string")
    titles = spark.createDataFrame([("1A00", "choléra"), ("1F00", "herpès")], "code string, libelle string")
    patients = spark.createDataFrame([(1, "1A00&X0", "NON")], "id bigint, code string, verdict string")
    pairs = spark.createDataFrame([("1A00", "1F00", "NON")], "code_dp string, code string, verdict string")
    none = lambda das: das.select("id").distinct().withColumn("verdict", F.lit("Aucun"))
    folder = jobs.generate_prompts(profiles, mapping, postcoord, labels, titles, patients, pairs, none, str(tmp_path / "p"), 40, 3, 10)
    rows = spark.read.parquet(folder).collect()
    assert "run_id=" in folder and {r.id for r in rows} == {i for i in range(40) if i % 2}
    assert all(r.code.startswith("1A00&X") and r.libelle == "forme " + r.code[-1] for r in rows) and not any(r.id == 1 and r.code == "1A00&X0" for r in rows)
    assert all("herpès" not in r.texte_das and ("1A00" in r.texte_das) == (r.id % 3 > 0) for r in rows)
    order = sorted((r.id, r.prompt_num, r.lot) for r in rows)
    assert [x[2] for x in order] == [n // 10 for n in range(len(order))]
