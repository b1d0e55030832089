"""Scans, look-ups, joins, grouping and sorting, as functions from DataFrames to DataFrames.

Each states what it computes and leaves the physical choice to Catalyst and
adaptive execution; a hint is given only where the operator's name asks for one
strategy.  Filters and columns reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates
from ..functions.predicates import between, conjunction, join_atom

#: A side is broadcast only if Catalyst's estimate of it is not above this many bytes.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its estimated size allows; else as it is, to be shuffled."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


# scans and look-ups


def scan(table: DataFrame, columns: Sequence[str | tuple[str, str]], *predicates: Column) -> DataFrame:
    """Rows that satisfy all predicates; columns in any order, repeated ones as (name, alias)."""
    out = [F.col(c) if isinstance(c, str) else F.col(c[0]).alias(c[1]) for c in columns]
    return table.filter(conjunction(*predicates)).select(*out)


def key_scan(table: DataFrame, key: str, low=None, high=None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """The keys of a range in key order, once for each row."""
    return table.filter(between(key, low, high, low_open, high_open) & F.col(key).isNotNull()).select(key).orderBy(key)


def lookup(table: DataFrame, key: str, literal) -> DataFrame:
    """The rows whose key equals a literal."""
    return table.filter(F.col(key) == F.lit(literal))


def range_lookup(table: DataFrame, key: str, low=None, high=None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """The rows whose key lies in a range; each bound given or not, open or closed."""
    return table.filter(between(key, low, high, low_open, high_open) & F.col(key).isNotNull())


def fetch(rids: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of the rows that rids (rid) name in a table with rid; repeated ids give repeated rows."""
    return rids.select("rid").join(table, "rid").select(*columns)


# joins (inner)


def nested_loop_join(outer: DataFrame, inner: DataFrame, on: Column | None) -> DataFrame:
    """Any predicate, or none for all pairs."""
    return outer.crossJoin(inner) if on is None else outer.join(inner, on)


def index_join(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str, residual: Column | None = None) -> DataFrame:
    """Look every outer row's key up in inner, with a further predicate on both rows.

    The inner table is hashed and broadcast if its size allows, else both sides
    are shuffled on the key.
    """
    on = F.col(outer_key) == F.col(inner_key)
    return outer.join(small(inner), on if residual is None else on & residual)


def merge_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], residual: Column | None = None) -> DataFrame:
    """Equi-join on one or more keys by sorting and merging; null keys match nothing."""
    on = conjunction(*[join_atom(a, "=", b) for a, b in keys])
    return left.hint("merge").join(right, on if residual is None else on & residual)


def correlated_joins(first: DataFrame, *steps: tuple[DataFrame, Column]) -> DataFrame:
    """Nested look-ups, each correlated with all rows before it: (table, condition) in order."""
    for table, on in steps:
        first = first.join(table, on)
    return first


# grouping and sorting


def group_by(df: DataFrame, keys: Sequence[str], aggs: Sequence[tuple[str, str, str]], having: Column | None = None) -> DataFrame:
    """aggs: (COUNT, SUM, AVG, MIN or MAX, column, alias); no keys: one row, also of nothing."""
    out = [aggregates.typed(df, kind, c).alias(alias) for kind, c, alias in aggs]
    grouped = df.groupBy(*keys).agg(*out) if keys else df.agg(*out)
    return grouped if having is None else grouped.filter(having)


def sort(df: DataFrame, *keys: str | tuple[str, bool]) -> DataFrame:
    """Keys ascending, or (key, False) descending; null is the lowest value."""
    order = [(k, True) if isinstance(k, str) else k for k in keys]
    return df.orderBy(*[F.col(k).asc_nulls_first() if up else F.col(k).desc_nulls_last() for k, up in order])
