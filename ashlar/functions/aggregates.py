"""Aggregates with the engine's own null and type rules.

COUNT counts nulls too and is an INT; SUM of nothing is 0 and keeps the column's
kind (integers widen to 64 bits instead of wrapping around); AVG of integers
truncates; MIN and MAX of nothing are null.  All of them combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def count_all(column: str | None = None) -> Column:
    return F.count(F.lit(1)).cast("int")


def sum_or_zero(column: str | Column, integral: bool = False) -> Column:
    total = F.sum(column)
    return F.coalesce(total, F.lit(0).cast("long") if integral else F.lit(0.0))


def avg_typed(column: str | Column, integral: bool = False) -> Column:
    if not integral:
        return F.avg(column)
    # Spark's div truncates towards zero, as integers do; nothing divided by nothing is null
    return F.call_function("div", F.sum(column), F.nullif(F.count(column), F.lit(0)))


def typed(df: DataFrame, kind: str, column: str) -> Column:
    """The aggregate COUNT, SUM, AVG, MIN or MAX of a column of df, by the column's type."""
    data = df.schema[column].dataType
    integral = isinstance(data, T.IntegralType)
    if kind in ("SUM", "AVG") and not isinstance(data, T.NumericType):
        raise TypeError(f"{kind} needs a number, {column} is {data.simpleString()}")
    make = {"COUNT": lambda: count_all(column), "SUM": lambda: sum_or_zero(column, integral), "AVG": lambda: avg_typed(column, integral), "MIN": lambda: F.min(column), "MAX": lambda: F.max(column)}
    return make[kind]()
