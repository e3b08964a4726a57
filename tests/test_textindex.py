import random

import pytest

from nosoflow.operators import relational, textindex

TEXTS = ["Choléra", "CHOLÉRA dû à Vibrio", "Fièvre typhoïde", "fièvre", "", None, "ab", "abc", "aXbXc", "100 % sûr_e", "İstanbul", "日本脳炎ウイルス", "aaaa", "tuberculose du poumon"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rnd = random.Random(4)
    words = ["choléra", "fièvre", "poumon", "rein", "gauche", "droit", "aigu", "chronique"]
    rows = [*enumerate(TEXTS), *((100 + i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 6))).title()) for i in range(300))]
    df = spark.createDataFrame(rows, "code bigint, libelle string")
    path = str(tmp_path_factory.mktemp("index") / "i")
    textindex.build(df, "code", "libelle", path)
    return df, path


@pytest.mark.parametrize("query", ["choléra", "CHOL", "fi%vre", "poumon%rein", "r_in", "ab", "a", "", None, "%", "___", "100 \\% s", "日本脳", "istan", "İST", "aaa", "rein gauche aigu", "introuvable", "d_oit%aig"])
def test_equals_a_search_of_all_rows(indexed, query):
    df, path = indexed
    want = sorted(map(tuple, relational.search(df, "libelle", query).na.fill("").collect()))
    assert sorted(map(tuple, textindex.indexed_search(df, "code", "libelle", query, path).na.fill("").collect())) == want


def test_only_the_lists_of_the_querys_runs_are_read(spark, indexed):
    df, path = indexed
    asked = textindex.required(spark, "poum%chro")
    assert asked == ["chr", "hro", "oum", "pou"] and textindex.required(spark, "p_u") == []
    plan = textindex.candidates(spark, path, "code", asked)._jdf.queryExecution().executedPlan().toString()
    partitions = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "groupe" in partitions and "In(suite" in plan


def test_an_empty_table_has_an_empty_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "abc")], "code bigint, libelle string").where("code < 0")
    assert df.select(textindex.runs(df.libelle)).collect() == []
