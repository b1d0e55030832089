"""A catalogue of Parquet tables: registration, lookup, statistics, row ids, uniqueness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partsupplier(lineitem: DataFrame) -> DataFrame:
    """The parts that suppliers offer, as the line items tell: one row for each (part, supplier)."""
    return lineitem.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(
        F.sum("l_quantity").cast("int").alias("ps_availqty"), F.min("l_extendedprice").alias("ps_supplycost")
    )


class Catalog:
    """Names of tables, case-insensitive, as temporary views of a session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def register(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(name)
        return df

    def register_dir(self, sf_dir: str, names=TABLES) -> Catalog:
        """Every table of a directory, and the derived partsupplier."""
        for name in names:
            self.register(name, read(self.spark, sf_dir, name))
        if "lineitem" in names:
            self.register("partsupplier", partsupplier(self.table("lineitem")))
        return self

    def has(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def schema(self, name: str) -> T.StructType:
        try:
            return self.spark.table(name).schema
        except AnalysisException as e:
            raise LookupError(f"there is no table {name}") from e

    def drop(self, name: str) -> bool:
        return self.spark.catalog.dropTempView(name)


def statistics(df: DataFrame, *columns: str) -> DataFrame:
    """One row: cardinality, and for each column its distinct count (estimated), low and high key."""
    found = [F.count(F.lit(1)).alias("cardinality")]
    for c in columns:
        found += [F.approx_count_distinct(c).alias(f"{c}_distinct"), F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high")]
    return df.agg(*found)


def analyse(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """Save df as a table with statistics of the table and the named columns (default: all), for plans by cost."""
    spark = df.sparkSession
    df.write.mode("overwrite").saveAsTable(name)
    which = "FOR COLUMNS " + ", ".join(columns) if columns else "FOR ALL COLUMNS"
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS {which}")
    return spark.table(name)


def with_row_id(df: DataFrame) -> DataFrame:
    """df of a file scan with rid: the file and the row's place in it."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("rid"))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """The keys that break uniqueness and their number of rows (null keys aside)."""
    rows = df.na.drop(subset=list(key))
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


class DuplicateError(ValueError):
    pass


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    if not duplicates(df, *key).isEmpty():
        raise DuplicateError(f"{', '.join(key)}: a key occurs more than once")
    return df
