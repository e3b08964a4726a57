import random

import pytest
from pyspark.sql import functions as F

from nosoflow.functions import bignum


@pytest.fixture(scope="module")
def numbers():
    rnd = random.Random(1)
    some = [rnd.randrange(10 ** rnd.randrange(1, 120)) for _ in range(60)]
    return some + [0, 1, 9, 10**9 - 1, 10**9, 10**9 + 1, 10**18 - 1, 10**18, 10**27 - 1, 10**90, 10**90 - 1]


def column(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_digits_and_limbs_are_the_same_number(spark, numbers):
    df = spark.createDataFrame([(i, str(n)) for i, n in enumerate(numbers)], "i int, s string")
    limbs = column(df, bignum.limbs_of(F.col("s")))
    assert all(sum(x * 10 ** (9 * k) for k, x in enumerate(part)) == n and all(0 <= x < 10**9 for x in part) for part, n in zip(limbs, numbers))
    assert column(df, bignum.digits(bignum.limbs_of(F.col("s")))) == [str(n) for n in numbers]
    positive = df.where("s <> '0'")
    assert column(positive, bignum.digits(bignum.limbs_of(F.col("s")), -1)) == [str(n - 1) for n in numbers if n]


@pytest.mark.parametrize("factor", [0, 1, 7, 4_999, 10**9, 3_999_999_999])
def test_products(spark, numbers, factor):
    df = spark.createDataFrame([(i, str(n)) for i, n in enumerate(numbers)], "i int, s string")
    found = column(df, bignum.digits(bignum.times(bignum.times(bignum.limbs_of(F.col("s")), F.lit(factor)), F.lit(factor))))
    assert found == [str(n * factor * factor) for n in numbers]


def test_powers_and_long_products(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.randrange(1, 4 * 10**9) for _ in range(rnd.randrange(0, 15))], rnd.randrange(0, 700)) for i in range(25)] + [(25, [], 0), (26, [0, 5], 31), (27, [], 30), (28, [3], 62)]
    df = spark.createDataFrame(rows, "i int, f array<bigint>, n bigint")
    want = []
    for _, factors, n in rows:
        value = 2**n
        for f in factors:
            value *= f
        want.append(str(value))
    assert column(df, bignum.digits(bignum.doubled(bignum.product(F.col("f")), F.col("n")))) == want


def test_order_is_that_of_the_numbers(spark, numbers):
    df = spark.createDataFrame([(i, str(n)) for i, n in enumerate(numbers)], "i int, s string")
    assert [int(r.s) for r in df.orderBy(bignum.order(F.col("s"))).collect()] == sorted(numbers)
    assert column(df, bignum.exceeds(F.col("s"), 10**9)) == [n > 10**9 for n in numbers]


def test_totals_by_group(spark, numbers):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), str(n)) for n in numbers for _ in range(rnd.randrange(1, 4))] + [("d", None)]
    df = spark.createDataFrame(rows, "g string, s string")
    want = {g: str(sum(int(s) for h, s in rows if h == g)) for g in "abc"}
    assert {r.g: r.t for r in bignum.totals(df, ["g"], "s", "t").collect()} == want
    assert bignum.totals(df, [], "s", "t").first().t == str(sum(map(int, want.values())))
    assert bignum.totals(df.limit(0), [], "s", "t").first().t is None
