"""Statements against a catalogue: SELECT gives its rows, the others one row with their count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.catalog import Catalog
from ..sources.storage import StoredTable
from . import dialect


class Engine:
    def __init__(self, spark: SparkSession, compat: bool = True) -> None:
        self.spark, self.compat, self.catalog = spark, compat, Catalog(spark)
        self.stored: dict[str, StoredTable] = {}

    def add_stored(self, name: str, table: StoredTable) -> None:
        """Make a stored table known, to read and to change."""
        self.stored[name.lower()] = table
        self.catalog.register(name, table.read())

    def explain_sql(self, text: str) -> str:
        return dialect.to_spark_sql(text, self.catalog.schema, self.compat)

    def execute(self, text: str) -> DataFrame:
        found = dialect.parse(text)
        writer = dialect.Writer(self.catalog.schema, self.compat)
        if isinstance(found, dialect.Select):
            return self.spark.sql(writer.select(found))
        name = found.table.lower()
        if name not in self.stored:
            if not self.catalog.has(found.table):
                raise dialect.SemanticError(f"there is no table {found.table}")
            raise dialect.SemanticError(f"{found.table} can't be changed")
        table = self.stored[name]
        if isinstance(found, dialect.Insert):
            out = table.insert(self._rows(found, table, writer))
        else:
            scope = {name: {f.name.lower(): f.dataType for f in table.schema}}
            if isinstance(found, dialect.Delete) and found.alias:
                scope = {found.alias.lower(): scope[name]}
            plain = lambda e: writer.expr(e, scope).replace(f"{dialect.quoted(next(iter(scope)))}.", "")
            where = " AND ".join(f"{plain(c.left)} {c.op} {plain(c.right)}" for c in found.where) or None
            out = table.delete(where) if isinstance(found, dialect.Delete) else table.update({c: plain(e) for c, e in found.sets}, where)
        self.catalog.register(found.table, table.read())
        return out

    def _rows(self, found: dialect.Insert, table: StoredTable, writer: dialect.Writer) -> DataFrame:
        names = found.columns or table.schema.fieldNames()
        if found.query is not None:
            rows = self.spark.sql(writer.select(found.query))
            if len(rows.columns) != len(names):
                raise dialect.SemanticError(f"{len(names)} columns are needed, the query has {len(rows.columns)}")
            return rows.toDF(*names)
        if any(len(r) != len(names) for r in found.rows):
            raise dialect.SemanticError(f"each row needs {len(names)} values")
        known = {f.name.lower(): f.dataType for f in table.schema}
        if missing := [n for n in names if n.lower() not in known]:
            raise dialect.SemanticError(f"no column {', '.join(missing)}")
        texts = self.spark.createDataFrame([[None if v is None else str(v) for v in r] for r in found.rows], T.StructType([T.StructField(n, T.StringType()) for n in names]))
        return texts.select(*[texts[n].cast(known[n.lower()]).alias(n) for n in names])
