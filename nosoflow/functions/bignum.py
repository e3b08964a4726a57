"""Whole numbers of any size: decimal digits as strings, arrays of 9-digit limbs (least first) to calculate with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = 1_000_000_000
_LONG = "bigint"
#: Doublings made at once; a factor is below 4 * 10^9.
_BITS = 31


def _div(a: Column, b: int) -> Column:
    """Quotient rounded down."""
    return F.call_function("div", a - F.pmod(a, F.lit(b).cast(_LONG)), F.lit(b).cast(_LONG))


def _carried(limbs: Column) -> Column:
    """Every limb hands its multiples of the base to the next. Limbs up to some billions are then the base and a few units at most."""
    longer = F.concat(limbs, F.array(F.lit(0).cast(_LONG)))
    return F.transform(longer, lambda x, i: F.pmod(x, F.lit(BASE).cast(_LONG)) + F.when(i > 0, _div(F.get(limbs, i - 1), BASE)).otherwise(0))


def _trimmed(limbs: Column) -> Column:
    """Without the highest limb if it is zero; there is one limb at least."""
    zero = (F.element_at(limbs, -1) == 0) & (F.size(limbs) > 1)
    return F.when(zero, F.slice(limbs, F.lit(1), F.greatest(F.size(limbs) - 1, F.lit(1)))).otherwise(limbs)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is calculated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def times(limbs: Column, factor: Column) -> Column:
    """Limbs of the product with a whole number from 0 to 4 * 10^9."""
    factor = factor.cast(_LONG)
    once = _let(F.transform(limbs, lambda x: x * factor), _carried)
    return _let(_let(once, _carried), lambda a: _let(_trimmed(a), _trimmed))


def product(factors: Column) -> Column:
    """Limbs of the product of an array of whole numbers below 4 * 10^9; 1 for an empty array, null if one is null."""
    return F.aggregate(factors, F.array(F.lit(1).cast(_LONG)), times)


def doubled(limbs: Column, n: Column) -> Column:
    """Limbs of the product with 2 to the ``n``."""
    whole, rest = (n - F.pmod(n, F.lit(_BITS))) / _BITS, F.pmod(n, F.lit(_BITS))
    steps = F.when(n >= _BITS, F.sequence(F.lit(1), whole.cast("int"))).otherwise(F.array().cast("array<int>"))
    many = F.aggregate(steps, limbs, lambda acc, _: times(acc, F.lit(1 << _BITS)))
    return times(many, F.pow(F.lit(2.0), rest).cast(_LONG))


def digits(limbs: Column, add: int = 0) -> Column:
    """Decimal digits of the number plus ``add``; the result is not negative. Limbs may be any sums of limbs."""
    start = F.struct(F.lit("").alias("text"), F.lit(add).cast(_LONG).alias("carry"))

    def step(acc: Column, limb: Column) -> Column:
        value = limb + acc["carry"]
        low = F.pmod(value, F.lit(BASE).cast(_LONG))
        return F.struct(F.concat(F.lpad(low.cast("string"), 9, "0"), acc["text"]).alias("text"), _div(value, BASE).alias("carry"))

    def shown(acc: Column) -> Column:
        text = F.regexp_replace(F.concat(acc["carry"].cast("string"), acc["text"]), "^0+", "")
        return F.when(text == "", F.lit("0")).otherwise(text)

    return F.aggregate(limbs, start, step, shown)


def limbs_of(number: Column) -> Column:
    """Limbs of a string of decimal digits."""
    length = F.length(number)
    places = F.sequence(F.lit(0), F.ceil(F.greatest(length, F.lit(1)) / 9).cast("int") - 1)

    def limb(i: Column) -> Column:
        end = length - 9 * i
        return F.substring(number, F.greatest(end - 8, F.lit(1)), F.least(end, F.lit(9))).cast(_LONG)

    return F.transform(places, limb)


def order(number: Column) -> Column:
    """A value that orders strings of decimal digits by the numbers they stand for."""
    return F.struct(F.length(number).alias("length"), number.alias("digits"))


def exceeds(number: Column, limit: int) -> Column:
    return order(number) > order(F.lit(str(limit)))


def totals(df: DataFrame, by: Sequence[str], number: str, name: str) -> DataFrame:
    """``by`` and ``name``: the sum of the strings of digits ``number`` in each group, null for a group without a number.

    Limbs are added up by position, on the map side first, so a group of very many rows is no more than its positions. Sums are exact for up to 9 * 10^9 rows.
    """
    limbs = df.select(*by, F.posexplode(limbs_of(F.col(number))).alias("_place", "_limb")).where("_limb IS NOT NULL")
    places = limbs.groupBy(*by, "_place").agg(F.sum("_limb").alias("_limb"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_place", "_limb"))), lambda x: x["_limb"])
    return places.groupBy(*by).agg(F.when(F.count(F.lit(1)) > 0, digits(listed)).alias(name))
