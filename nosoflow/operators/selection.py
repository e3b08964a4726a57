"""The first N rows of an order, for an N that no single task should hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nosoflow.operators.scaling import cut_lineage

#: Rows that one task may sort; so many and fewer first rows are Spark's own ordered limit.
HELD = 10_000
BINS = 4096
#: Bytes of a string that one number stands for.
_BYTES = 7


def _fields(df: DataFrame, order: Sequence[str]) -> list[tuple[Column, T.DataType]]:
    """The order's columns, structs as their fields."""
    out = []

    def add(column: Column, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                add(column.getField(field.name), field.dataType)
        else:
            out.append((column, kind))

    for name in order:
        add(F.col(name), df.schema[name].dataType)
    return out


def _numbers(df: DataFrame, order: Sequence[str]) -> list[tuple[Column, str]]:
    """Numbers that order rows as ``order`` does, nulls first, with their types. A string is a number for every seven of its bytes."""
    fields = _fields(df, order)
    texts = [c for c, kind in fields if isinstance(kind, T.StringType)]
    longest = iter(df.agg(*(F.max(F.octet_length(c)) for c in texts)).first() if texts else [])
    out = []
    for column, kind in fields:
        out.append((column.isNotNull().cast("int"), "int"))
        if isinstance(kind, T.StringType):
            data = F.encode(column, "utf-8")
            for start in range(0, next(longest) or 0, _BYTES):
                part = F.rpad(F.hex(F.substring(data, start + 1, _BYTES)), 2 * _BYTES, "0")
                out.append((F.coalesce(F.conv(part, 16, 10).cast("bigint"), F.lit(0)), "bigint"))
            out.append((F.coalesce(F.octet_length(column), F.lit(0)), "int"))  # tells zero bytes from none
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            out.append((F.coalesce(column.cast("double"), F.lit(0.0)), "double"))
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            whole = F.unix_micros(column.cast("timestamp")) if not isinstance(kind, T.DateType) else F.unix_date(column)
            out.append((F.coalesce(whole.cast("bigint"), F.lit(0)), "bigint"))
        elif isinstance(kind, T.IntegralType):
            out.append((F.coalesce(column.cast("bigint"), F.lit(0)), "bigint"))
        else:
            raise TypeError(f"no order by {kind.simpleString()}")
    return out


def _bin(name: str, kind: str, low, high) -> Column:
    """Number of one of ``BINS`` equal parts from ``low`` to ``high``."""
    if kind == "double":
        share = (F.col(name) - F.lit(low)) / F.lit(high - low)
        return F.least(F.floor(share * BINS), F.lit(BINS - 1))
    wide = "decimal(38,0)"
    return F.floor((F.col(name).cast(wide) - F.lit(low).cast(wide)) * BINS / F.lit(str(high - low + 1)).cast(wide))


def _last_row(rows: DataFrame, keys: list[tuple[str, str]], n: int) -> tuple | None:
    """Values of the ``n``-th row's keys; None if there are no more than ``n`` rows.

    Histograms of one key after another narrow the rows down to the bin that holds the ``n``-th, until so few are left that a task sorts them, or all keys are fixed.
    """
    if rows.count() <= n:
        return None
    names = [name for name, _ in keys]
    fixed: list = []
    for name, kind in keys:
        low, high, left = rows.agg(F.min(name), F.max(name), F.count(F.lit(1))).first()
        while low != high and left > HELD:
            bins = rows.groupBy(_bin(name, kind, low, high).alias("b")).agg(
                F.min(name).alias("low"), F.max(name).alias("high"), F.count(F.lit(1)).alias("n")).collect()  # BINS rows at most
            for b in sorted(bins, key=lambda b: b.low):
                if n <= b.n:
                    break
                n -= b.n
            low, high, left = b.low, b.high, b.n
            rows = rows.where(F.col(name).between(F.lit(low), F.lit(high)))
        if left <= HELD:
            return tuple(rows.orderBy(*names).limit(n).orderBy(*(F.desc(x) for x in names)).first()[x] for x in names)
        fixed.append(low)
    return tuple(fixed)


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The ``n`` first rows by the columns ``order``, ascending, nulls first; all if there are fewer. ``order`` should tell all rows apart.

    Many rows are not brought together to be cut: their order's ``n``-th value is found by histograms, then the rows up to it are kept where they are. Of rows
    that are equal in all columns of ``order`` any may be among the first.
    """
    if n <= HELD:
        return df.orderBy(*order).limit(max(n, 0))
    numbers = _numbers(df, order)
    names = [f"_key{i}" for i in range(len(numbers))]
    rows = cut_lineage(df.withColumns({name: number.cast(kind) for name, (number, kind) in zip(names, numbers)}))
    last = _last_row(rows.select(*names), [(name, kind) for name, (_, kind) in zip(names, numbers)], n)
    if last is None:
        return rows.drop(*names)
    key, bound = F.struct(*names), F.struct(*(F.lit(value).cast(kind).alias(name) for value, name, (_, kind) in zip(last, names, numbers)))
    before = rows.where(key < bound)
    ties = rows.where(key == bound)
    found, equal = before.count(), ties.count()
    if found + equal > n:
        ties = ties.limit(n - found)
    return before.unionByName(ties).drop(*names)
