"""Number expressions: nearest-rank percentile, big-number format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_rank(values: Column, share: float, minimum: int) -> Column:
    """Sorted element ``int(n * share)`` counted from one, null below ``minimum`` values."""
    n = F.size(values)
    rank = F.floor(n * F.lit(float(share))).cast("int")
    return F.when(n >= minimum, F.element_at(F.array_sort(values), F.greatest(rank, F.lit(1))))


def format_big(number: Column) -> Column:
    """Thousands separators below a million, else ``d.ddddd × 10^k (~10^x.x)``. ``number`` is a whole number, or its digits as a string."""
    digits = number.cast("string")
    power = F.format_number(F.log10(F.substring(digits, 1, 15).cast("double")) + F.greatest(F.length(digits) - 15, F.lit(0)), 1)
    large = F.concat(
        F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5),
        F.lit(" × 10^"), (F.length(digits) - 1).cast("string"), F.lit(" (~10^"), power, F.lit(")"),
    )
    return F.when(F.length(digits) <= 6, F.format_number(F.substring(digits, 1, 6).cast("bigint"), 0)).otherwise(large)
