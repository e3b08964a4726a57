import random

import pytest
from pyspark.sql import functions as F

from nosoflow.operators import relational, scaling


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 11 == 0 else f"k{rnd.randrange(40)}") for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id int, k string")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, no_broadcast, skewed, how):
    rows, facts = skewed
    lookup = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(20)], "k string, v int")
    joined = scaling.lookup_join(facts, lookup, "k", how)
    assert "_salt" not in joined.columns
    plain = facts.join(lookup, "k", how)
    assert sorted(map(str, joined.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_a_hot_key_is_cut_by_adaptive_execution(spark, no_broadcast):
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2.0",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    facts = spark.range(0, 60_000, 1, 8).selectExpr("id", "IF(id % 3 = 0, 'hot', concat('k', id % 997)) AS k")
    joined = scaling.lookup_join(facts, spark.range(997).selectExpr("concat('k', id) AS k", "id AS v").unionByName(
        spark.sql("SELECT 'hot' AS k, -1L AS v")), "k")
    assert joined.where("v = -1").groupBy().sum("id").first()[0] == sum(range(0, 60_000, 3))
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert "skew=true" in plan


@pytest.mark.parametrize("name", ["verify_codes", "translate_lists", "das_text", "code_detail", "well_documented_codes", "evaluate_codes", "prf_metrics"])
def test_large_tables_are_read_few_times_without_broadcasts(spark, no_broadcast, name):
    from nosoflow.plans.catalog import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for table, most in (("lineitem", 4), ("orders", 3)):
        assert plan.count(f"{table}.parquet") <= most, (name, table, plan.count(f"{table}.parquet"))


def test_broadcast_only_below_the_limit(spark, tmp_path):
    spark.range(1000).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    assert scaling.fits_broadcast(small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10b")
    assert not scaling.fits_broadcast(small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")


def test_ordinals_equal_sorted_position(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), rnd.randrange(10_000_000), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, t int, i int")
    got = scaling.ordinals(df, ["t", "i"], F.floor(F.col("t") / 700), by=["g"])
    expected = {}
    for g in "ab":
        for n, row in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1):
            expected[row[2]] = n
    assert {r.i: r.pos for r in got.collect()} == expected
    whole = scaling.ordinals(df, ["t", "i"], F.floor(F.col("t") / 700))
    assert sorted(r.pos for r in whole.collect()) == list(range(1, 4001))


def test_rolling_rows_equal_uncut_window(spark):
    rows = [("a", i, (i * 37) % 101) for i in range(1, 500)] + [("b", 1, 5)]
    df = spark.createDataFrame(rows, "g string, pos int, v int")
    got = scaling.rolling_rows(df, ["g"], "pos", 20, {"s": F.sum("v"), "n": F.count("v")}, chunk=50).collect()
    assert len(got) == len(rows)
    values = [r[2] for r in rows if r[0] == "a"]
    for r in got:
        if r.g == "a":
            last = values[max(0, r.pos - 20):r.pos]
            assert (r.s, r.n) == (sum(last), len(last))


def test_first_per_key_is_cut_before_the_shuffle(spark, skewed):
    _, facts = skewed
    first = relational.first_per_key(facts, ["k"], ["id"], 2)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")
    assert first.where("k = 'hot'").count() == 2


def test_checkpoint_folder(spark):
    assert scaling.cut_lineage(spark.range(3)).count() == 3
    assert spark.sparkContext.getCheckpointDir() is not None
    assert scaling.shared_folder(spark)


def test_keep_last_and_pages(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 3)], "k string, v string, o int")
    assert sorted(map(tuple, relational.keep_last_map(df, F.col("k"), F.col("v"), ["o"]).collect())) == [("a", "y"), ("b", "z")]
    assert [r.o for r in relational.page(df, ["o"], 1, 1).collect()] == [2]
    with pytest.raises(ValueError):
        relational.page(df, ["o"], 501)
    with pytest.raises(ValueError):
        relational.page(df, ["o"], 5, 10**6)
    assert [r.o for r in relational.page_after(df, "o", 1, 1).collect()] == [2] and relational.page_after(df, "o", None, 5).count() == 3
    assert relational.search(df, "v", "_").count() == 3 and relational.search(df, "v", "Y").count() == 1
