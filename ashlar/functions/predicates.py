"""Predicates as Columns: comparisons, ranges, conjunctions, disjunctions.

Null in a comparison never satisfies it, which a filter or an inner join gives by
itself.  Catalyst folds, orders and pushes what is built here.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
#: The operator that is true where the other is false (for values that aren't null), and that with its sides switched.
INVERSE = {"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
MIRRORED = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def _side(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def atom(column: str | Column, op: str, literal) -> Column:
    """column op literal; a str literal is a value here, not a column."""
    return OPERATORS[op](_side(column), literal if isinstance(literal, Column) else F.lit(literal))


def join_atom(left: str | Column, op: str, right: str | Column) -> Column:
    """left column op right column."""
    return OPERATORS[op](_side(left), _side(right))


def between(column: str | Column, low=None, high=None, low_open: bool = False, high_open: bool = False) -> Column:
    """A range of one column, each bound given or not, open or closed."""
    parts = []
    if low is not None:
        parts.append(atom(column, ">" if low_open else ">=", low))
    if high is not None:
        parts.append(atom(column, "<" if high_open else "<=", high))
    return conjunction(*parts)


def conjunction(*parts: Column) -> Column:
    return reduce(operator.and_, parts) if parts else F.lit(True)


def disjunction(*parts: Column) -> Column:
    return reduce(operator.or_, parts) if parts else F.lit(False)
