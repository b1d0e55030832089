"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's larger (small star: smaller) neighbours are tied to the smallest node of its neighbourhood.

    The minimum is aggregated before the shuffle and joined back, so a node with
    very many neighbours is never gathered in one place.  It is written first:
    then both sides of the join come straight from a shuffle, and adaptive
    execution can split the edges of such a node.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = checkpoint(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("low")))
    tied = both.join(low, "u")
    if large:
        tied = tied.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        tied = tied.select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v"))
    return tied.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v; any order, repeats and loops allowed) -> (node, root), root the smallest node reachable.

    A row for each node that has an edge to another.  Null ends are ignored.
    Each round is written to the shared checkpoint folder; the rounds grow with
    the logarithm of the longest path.
    """
    edges = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        edges = checkpoint(_star(_star(edges, large=True), large=False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
