"""What a plan does: the strategy of joins, what reaches the scans, exchanges."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_JOINS = ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct")


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df: DataFrame) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def joins(df: DataFrame) -> list[str]:
    """The joins of the plan, topmost first."""
    return re.findall("|".join(rf"\b{j}\b" for j in _JOINS), plan(df))


def pushed_filters(df: DataFrame) -> list[str]:
    return [x for m in re.findall(r"PushedFilters: \[([^\]]*)\]", plan(df)) for x in re.split(r", (?=[A-Z])", m) if x]


def read_columns(df: DataFrame) -> list[str]:
    """The columns that the scans read."""
    return [c.split(":")[0] for m in re.findall(r"ReadSchema: struct<([^>]*)>", plan(df)) for c in m.split(",") if c]


def exchanges(df: DataFrame) -> int:
    return len(re.findall(r"\bExchange (?:hash|range|Single|Round)", plan(df)))


@contextmanager
def cost_based(spark: SparkSession) -> Iterator[None]:
    """Join reordering by costs, for tables that have been analysed (ANALYZE TABLE ... FOR COLUMNS)."""
    keys = ("spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled", "spark.sql.cbo.planStats.enabled")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "true")
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
