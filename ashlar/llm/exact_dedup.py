"""Exact dedup by content sort [native: DataFrame functions only].

Rows are range-partitioned by a bounded key of the normalised text (its first
characters, then a 64-bit hash of the whole), with splitters that Spark samples.
Inside a partition the external sort puts equal texts next to each other; the
window operator then compares each row's whole normalised text with its
neighbour's, and one row of each run of equals is retained.  The text crosses
the network once.

Hot texts: an exact count by hash (map-side combined) finds the texts that have
more than ``rows / (4 x partitions)`` rows.  Only those get a salt, so that a run
spreads over many ranges; there are at most ``4 x partitions`` of them, so the
table of them is broadcast.  The runs' heads are then merged by SHA-256, a few
rows for each hot text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, lower_ascii, shuffle_partitions

#: Characters of the normalised text in the range key; bounds what the sampling sends to the driver.
PREFIX = 32


def _hot(docs: DataFrame, text: Column, share: float) -> DataFrame | None:
    """(hash, salts) of the texts that have too many rows for one partition; None if there are none."""
    limit = max(1, int(docs.count() * share / shuffle_partitions(docs.sparkSession)))
    found = checkpoint(
        docs.groupBy(F.xxhash64(lower_ascii(text)).alias("__hot"))
        .count()
        .filter(F.col("count") > limit)
        .select("__hot", F.ceil(F.col("count") / limit).alias("__salts"))
    )
    return None if found.isEmpty() else found


def _runs(docs: DataFrame, id_col: str, text_col: str, keep: str, hot: DataFrame | None) -> DataFrame:
    """The content sort: docs with __run_keep, __run_size and __run_rank (1: the head of its run)."""
    norm = lower_ascii(F.col(text_col))
    rows = docs.withColumns({"__prefix": F.substring(norm, 1, PREFIX), "__hash": F.xxhash64(norm)})
    if hot is None:
        rows = rows.withColumn("__salt", F.lit(None).cast("long"))
        key = ["__prefix", "__hash"]
    else:
        rows = rows.join(F.broadcast(hot), F.col("__hash") == F.col("__hot"), "left")
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64(F.col(id_col)), F.col("__salts"))).drop("__hot", "__salts")
        key = ["__prefix", "__hash", "__salt"]
    rows = rows.repartitionByRange(*key).withColumn("__norm", norm)
    run = Window.partitionBy(*key, "__norm")
    first = F.col(id_col).desc_nulls_last() if keep == "max" else F.col(id_col).asc_nulls_last()
    return rows.withColumns(
        {
            "__run_keep": F.first(F.col(id_col)).over(run.orderBy(first)),
            "__run_rank": F.row_number().over(run.orderBy(first)),
        }
    ).withColumn("__run_size", F.count(F.lit(1)).over(run))


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hot_share: float = 0.25) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical after lower-casing A-Z.  Null texts
    count as empty, so they equal empty ones.  Of equal texts the row with the
    smallest id (``keep='max'``: the largest) stays; null ids only if the group
    has no other.  Of repeated rows with the winning id exactly one is kept.
    Other columns pass through; names that begin with two underscores are ours,
    and columns named like a result column are replaced.  An empty table gives
    an empty result.
    """
    docs = docs.drop(*(c for c in ("keep_id", "group_size", "kept", "text_sha256") if c not in (id_col, text_col)))
    columns = docs.columns
    hot = _hot(docs, F.col(text_col), hot_share)
    rows = _runs(docs, id_col, text_col, keep, hot)
    sha = F.sha2(F.col("__norm"), 256)
    found = rows.select(*columns, "__hash", "__salt", "__run_keep", "__run_size", "__run_rank", sha.alias("text_sha256")) if hot is not None else rows.select(*columns, "__run_keep", "__run_size", "__run_rank", sha.alias("text_sha256"))
    if hot is None:
        return found.select(
            *columns,
            F.col("__run_keep").alias("keep_id"),
            F.col("__run_size").alias("group_size"),
            (F.col("__run_rank") == 1).alias("kept"),
            "text_sha256",
        )
    # the heads of the hot runs meet: a few rows for each hot text
    few = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(hot), F.xxhash64(lower_ascii(F.col(text_col))) == F.col("__hot"), "left_semi")
    heads = _runs(few, id_col, text_col, keep, hot).filter("__run_rank = 1")
    best = F.max("__run_keep") if keep == "max" else F.min("__run_keep")
    merged = heads.groupBy(sha.alias("__sha")).agg(
        best.alias("__keep"),
        F.sum("__run_size").alias("__size"),
        F.min(F.when(F.col("__run_keep").isNull(), F.col("__salt"))).alias("__null_salt"),
    )
    hot_row = F.col("__sha").isNotNull()
    return found.join(F.broadcast(merged), F.col("text_sha256") == F.col("__sha"), "left").select(
        *columns,
        F.when(hot_row, F.col("__keep")).otherwise(F.col("__run_keep")).alias("keep_id"),
        F.when(hot_row, F.col("__size")).otherwise(F.col("__run_size")).alias("group_size"),
        (
            (F.col("__run_rank") == 1)
            & (
                ~hot_row
                | F.coalesce(F.col(id_col) == F.col("__keep"), F.lit(False))
                | (F.col("__keep").isNull() & (F.col("__salt") == F.col("__null_salt")))
            )
        ).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """docs without the rows that repeat another's text."""
    return content_groups(docs, id_col, text_col, keep).filter("kept").select(*docs.columns)


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of documents; edge cases as in ``content_groups``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return content_groups(docs, keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
