"""Null-safe numeric column helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(column: Column) -> Column:
    """Text or number to double; anything unreadable, and NaN, becomes null."""
    value = column.try_cast("double")
    return F.when(~F.isnan(value), value)


def whole(column: Column, default: int) -> Column:
    return F.coalesce(number(column).cast("bigint"), F.lit(default).cast("bigint"))


def strip(column: Column) -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def strict(function, *columns: Column) -> Column:
    """Apply ``least``/``greatest`` but give null if any argument is null."""
    present = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    return F.when(present, function(*columns))


def clip(column: Column, low: float, high: float) -> Column:
    return F.when(
        column.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), column))
    )


def logit(column: Column, edge: float = 1e-6) -> Column:
    p = clip(column, edge, 1.0 - edge)
    return F.log(p / (F.lit(1.0) - p))


def expit(column: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(column, -30.0, 30.0)))


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def flag(condition: Column) -> Column:
    """A condition as 0/1, with unknown counted as 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def lookup(table: dict, key: Column, default) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))
