import pytest

from nosoflow.operators import lookup, terminology as t


@pytest.fixture(params=["broadcast", "large"])
def both(request, spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    if request.param == "large":
        spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, "10485760b")


def test_well_documented_codes(spark):
    codes = spark.createDataFrame([("1A00", "Choléra", "title"), ("2B00", "Autre", "title"), ("3C00", "Sans DP", "title")], "code string, libelle string, type string")
    diag = spark.createDataFrame([(1, "DP", "1A00"), (2, "DP", "2B00"), (3, "DAS", "3C00"), (4, "DP", "1A00")], "id_crh int, type_diag string, code_cim11 string")
    crh = spark.createDataFrame([(1, "texte b"), (2, "texte"), (3, "texte"), (4, "texte a")], "id_crh int, texte_crh string")
    syn = spark.createDataFrame([("1A00", "s1"), ("1A00", "s2"), ("3C00", "s3")], "code_cim11 string, synonyme string")
    pc = spark.createDataFrame([("1A00", "1A00&X1"), ("1A00", "1A00&X2"), ("1A00", "1A00&X2"), ("3C00", "3C00&X1")], "code_racine string, code_postcoord string")
    rows = t.well_documented_codes(codes, diag, crh, syn, pc).collect()
    assert [tuple(r) for r in rows] == [("1A00", "Choléra", 2, 2, "texte a")]


def test_loads(spark, both):
    terms = spark.createDataFrame([(0, "A1", "un", "title"), (1, "A1", "bis", "indexTerm"), (2, "A2", "deux", "title"), (3, "A3", "trois", "title")],
                                  "ord int, code string, texte string, type string")
    codes = t.load_codes(terms, ["ord"], 2)
    assert sorted(map(tuple, codes.collect())) == [("A1", "un", "title"), ("A2", "deux", "title")]
    icd = t.icd_map(spark.createDataFrame([(0, "X", "A9"), (1, "X", "A1"), (2, "Y", "A3")], "ord int, icd10 string, icd11 string"), ["ord"])
    syn = spark.createDataFrame([(0, "X", "s0", "a"), (1, "Y", "s1", "a"), (2, "W", "s2", "a"), (3, "X", "s3", "b"), (4, "Y", "s4", "b")],
                                "ord int, code string, synonyme string, source string")
    assert [r.synonyme for r in t.load_synonyms(syn, icd, codes, ["ord"]).orderBy("ord").collect()] == ["s0", "s3"]
    assert tuple(t.synonym_load_counts(syn, icd, codes, ["ord"]).first()) == (2, 3)
    assert tuple(t.synonym_load_counts(syn, icd, codes, ["ord"], 2).first()) == (2, 2)
    assert tuple(t.synonym_load_counts(syn, icd, codes, ["ord"], 1).first()) == (1, 0)
    pc = spark.createDataFrame([(0, "A1", "A1&X"), (1, "A9", "A9&X"), (2, "A1", "A1&X"), (3, "A2", "A2&X")], "ord int, code_racine string, code_postcoord string")
    pc = pc.selectExpr("*", "concat('l', ord) AS libelles_extensions")
    assert sorted(r.libelles_extensions for r in t.load_postcoord(pc, codes, ["ord"]).collect()) == ["l0", "l3"]
    axes = spark.createDataFrame([(0, "A1", "axe", "NotAllowed", "", ""), (1, "A2", "axe", "AllowAlways", "12", "trop"), (2, "A7", "axe", "x", "1", "")],
                                 "ord int, code string, axe_nom string, allow_multiple string, taille_axe string, raison_arret string")
    assert [tuple(r)[3:] for r in t.load_axes(axes, codes, ["ord"]).orderBy("code_cim11").collect()] == [(None, None), (12, "trop")]


def test_dictionary(spark):
    rows = [(0, "B1", "toux", "s2"), (1, "B2", "toux", "s1"), (2, "B3", "toux", "s2"), (3, "Z1", "bilan", "s1"), (4, None, "x", "s1")]
    df = spark.createDataFrame(rows, "ord int, code string, synonyme string, source string")
    d = t.synonym_dictionary(df, ["ord"])
    assert sorted(map(tuple, d.collect())) == [("bilan", "Z1", "s1"), ("toux", "B1", "s2 / s1")]
    assert [r.synonyme for r in t.without_chapter(d).collect()] == ["toux"]


def test_translation(spark, both):
    mapping = spark.createDataFrame([(0, "C18.0", "2B90.Y"), (1, "S72", "NC72"), (2, "M23", "FA30 "), (3, "C180", "2B90.1"), (4, "A00", None)],
                                    "ord int, icd10 string, icd11 string")
    icd = lookup.translation_map(mapping, ["ord"])
    profiles = spark.createDataFrame([(1, "C180"), (2, "S7200"), (3, "S72"), (4, "XXXX"), (5, "M23")], "id int, c string")
    got = {r.id: r.icd11 for r in lookup.translate(profiles, "c", icd).collect()}
    assert got == {1: "2B90.1", 2: "NC72", 3: "NC72", 4: None, 5: "FA30"}
    lists = spark.createDataFrame([(1, ["M23", " ", "XXXX", "C180"]), (2, []), (3, None)], "id int, l array<string>")
    done = {r.id: r.x for r in lookup.translate_lists(lists, "id", "l", icd, "x").collect()}
    assert done == {1: ["FA30", "2B90.1"], 2: [], 3: None}


def test_code_detail_tells_not_found(spark):
    codes = spark.createDataFrame([("A1", "un", "title"), ("A2", "deux", "title")], "code string, libelle string, type string")
    syn = spark.createDataFrame([("A1", "s", "a")], "code_cim11 string, synonyme string, source string")
    pc = spark.createDataFrame([("A1", "A1&X"), ("A1", "A1&Y")], "code_racine string, code_postcoord string")
    wanted = spark.createDataFrame([("A1",), ("A2",), ("Q",)], "code string")
    rows = t.code_detail(wanted, codes, syn, pc).collect()
    assert len(rows) == 5 and {r.code: r.trouve for r in rows} == {"A1": True, "A2": True, "Q": False}


def test_verdicts_fail_open(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d")], "id int, code string")
    verdicts = spark.createDataFrame([(1, "a", "NON"), (1, "b", " oui "), (1, "c", None)], "id int, code string, verdict string")
    assert sorted(r.code for r in lookup.apply_verdicts(rows, verdicts, ["id", "code"]).collect()) == ["b", "c", "d"]
    group = spark.createDataFrame([(1, "A, C"), (2, "D")], "id int, verdict string")
    upper = spark.createDataFrame([(1, "A"), (1, "B"), (1, "C"), (2, "D")], "id int, code string")
    assert sorted(r.code for r in lookup.apply_group_verdicts(upper, group, "id", "code").collect()) == ["B", "D"]
