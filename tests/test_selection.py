import random

import pytest
from pyspark.sql import functions as F

from nosoflow.operators import relational, sampling, selection


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(selection, "HELD", 20)
    monkeypatch.setattr(selection, "BINS", 8)


@pytest.mark.parametrize("order", [["n"], ["word", "n"], ["part", "n"], ["x", "n"], ["day", "n"], ["place"], ["maybe", "n"]])
def test_equals_an_ordered_limit(spark, few, order):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice(["a", "b", "é", "\x00", "zz"]) for _ in range(rnd.randrange(12)))
    rows = [(i * 7919 % 1501 - 700, word(), rnd.randrange(2), rnd.choice([-1e300, 0.0, 1e-300, rnd.random(), 1e300]), rnd.choice([None, 3, 4])) for i in range(1500)]
    df = spark.createDataFrame(rows, "n bigint, word string, part int, x double, maybe int").repartition(5)
    df = df.withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("part"))).withColumn("place", F.struct("word", "part", "n"))
    for n in (1, 20, 21, 400, 1499, 1500, 5000):
        got = [r.n for r in selection.first_rows(df, order, n).orderBy(*order).collect()]
        assert got == [r.n for r in df.orderBy(*order).limit(n).collect()]


def test_equal_rows_count_as_often_as_asked(spark, few):
    df = spark.range(300).select((F.col("id") % 3).alias("k"))
    for n in (50, 100, 150, 299):
        assert sorted(r.k for r in selection.first_rows(df, ["k"], n).collect()) == ([0] * 100 + [1] * 100 + [2] * 100)[:n]


def test_extreme_numbers(spark, few):
    values = [-(1 << 63), -(1 << 63) + 1, (1 << 63) - 1, 0, 5, 6, *range(1000, 1100)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert sorted(r.v for r in selection.first_rows(df, ["v"], 40).collect()) == sorted(values)[:40]


def test_large_samples_and_limits_sort_in_no_single_task(spark):
    df = spark.range(400_000).select("id", F.lit(1).alias("w"))
    taken = [selection.first_rows(df, ["id"], 150_000), sampling.seeded_sample(df, 60_000, "id", 3), sampling.weighted_sample(df, 60_000, "w", "id", 3), relational.load_limit(df, ["id"], 30_000)]
    for frame, n in zip(taken, (150_000, 60_000, 60_000, 30_000)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Limit" not in plan and "TakeOrdered" not in plan and "SinglePartition" not in plan
        assert frame.count() == n
    assert taken[0].agg(F.max("id")).first()[0] == 149_999
    hashed = df.withColumn("h", sampling.hash_number(3, "id")).orderBy("h", "id").limit(60_000)
    assert hashed.join(taken[1], "id").count() == 60_000


def test_empty(spark, few):
    df = spark.range(0)
    assert selection.first_rows(df, ["id"], 100).collect() == [] and selection.first_rows(df, ["id"], 0).collect() == []
