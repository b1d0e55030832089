"""Stored tables that can be changed: immutable Parquet files and a list of files for each version.

An insert writes only its own rows; a delete or update rewrites only the files
that hold rows concerned.  A version is a small file that names the data files; it
is created only if it doesn't exist, so of two writers one loses and must retry,
and readers see a whole version or the one before.  This holds where the file
system creates a file only once: on HDFS by rename, on local folders and object
stores with conditional puts by creation; on an object store without them let one
writer at a time change a table.  All access goes through Spark's file systems.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import require_unique, with_row_id


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is named and all run in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or "file://" + tempfile.mkdtemp(prefix="ashlar-")


class ConflictError(RuntimeError):
    """Another writer made the version first."""


class StoredTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, unique: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> StoredTable:
        """A new table.  Columns in unique hold no value twice; keys are columns by which rows are looked up.

        Files have Bloom filters of both, and if there are keys each insert lays its
        rows out in ranges of the first one, so that a look-up reads few of them.
        """
        table = cls(spark, path)
        table._write_version(0, {"schema": schema.json(), "unique": list(unique), "keys": list(keys), "files": []})
        return table

    def _versions(self) -> list[int]:
        found = self._fs.listStatus(self._path(f"{self.path}/versions"))
        return sorted(int(f.getPath().getName().split(".")[0]) for f in found if f.getPath().getName().endswith(".json"))

    def _write_version(self, number: int, content: dict) -> None:
        """Create the version's file, or raise ConflictError if there is one.

        Where a rename never replaces a file (HDFS), it is written aside first and
        renamed.  Elsewhere (local folders, object stores) the file system's own
        creation without overwriting decides.
        """
        data = bytearray(json.dumps(content).encode())
        target = self._path(f"{self.path}/versions/{number:010d}.json")
        if self._fs.getScheme() in ("hdfs", "viewfs"):
            aside = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}")
            self._put(aside, data)
            if self._fs.exists(target) or not self._fs.rename(aside, target):
                self._fs.delete(aside, False)
                raise ConflictError(f"version {number} of {self.path} exists")
            return
        try:
            self._put(target, data)
        except Py4JJavaError as e:
            if self._fs.exists(target):
                raise ConflictError(f"version {number} of {self.path} exists") from e
            raise

    def _put(self, path, data: bytearray) -> None:
        out = self._fs.create(path, False)
        out.write(data)
        out.close()

    def _read_version(self, number: int | None = None) -> tuple[int, dict]:
        number = self._versions()[-1] if number is None else number
        row = self.spark.read.text(f"{self.path}/versions/{number:010d}.json", wholetext=True).first()
        return number, json.loads(row[0])

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self._read_version()[1]["schema"]))

    def _scan(self, content: dict, files: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(content["schema"]))
        files = content["files"] if files is None else files
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in files])

    def read(self, version: int | None = None) -> DataFrame:
        return self._scan(self._read_version(version)[1])

    def read_with_rid(self) -> DataFrame:
        """Rows and rid; a row id holds for as long as its file does."""
        content = self._read_version()[1]
        if not content["files"]:
            return self._scan(content).withColumn("rid", F.lit(None).cast("struct<file:string,row:bigint>"))
        return with_row_id(self._scan(content))

    def _add(self, df: DataFrame, content: dict) -> list[str]:
        name, keys = uuid.uuid4().hex, content.get("keys", [])
        if keys:
            # files with ranges of the first key: a look-up's file statistics leave out the others
            df = df.repartitionByRange(keys[0]).sortWithinPartitions(keys[0])
        out = df.write
        for key in dict.fromkeys([*content["unique"], *keys]):
            out = out.option(f"parquet.bloom.filter.enabled#{key}", "true")
        out.parquet(f"{self.path}/data/{name}")
        found = self._fs.listStatus(self._path(f"{self.path}/data/{name}"))
        return [f"{name}/{f.getPath().getName()}" for f in found if f.getPath().getName().endswith(".parquet")]

    def _count(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "count long")

    def insert(self, rows: DataFrame) -> DataFrame:
        """Append rows (matched by name, missing columns null); one row: their number.  Broken uniqueness raises and changes nothing."""
        number, content = self._read_version()
        schema = T.StructType.fromJson(json.loads(content["schema"]))
        known = {f.name.lower(): f.name for f in schema}
        extra = [c for c in rows.columns if c.lower() not in known]
        if extra:
            raise LookupError(f"the table has no column {', '.join(extra)}")
        given = {c.lower(): c for c in rows.columns}
        ready = rows.select(*[(F.col(given[f.name.lower()]) if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        files = self._add(ready, content)
        new = content["files"] + files
        for c in content["unique"]:
            require_unique(self._scan(content, new), c)
        n = self._scan(content, files).count() if files else 0
        self._write_version(number + 1, content | {"files": new})
        return self._count(n)

    def _rewrite(self, pick, change) -> DataFrame:
        """Replace the files that hold the rows that pick selects (rows with rid -> rid) by what change makes of them.

        One version is read once and is the one that the new version follows: if
        another writer commits in between, this writer gets a ConflictError.
        """
        number, content = self._read_version()
        if not content["files"]:
            return self._count(0)
        hits = pick(with_row_id(self._scan(content))).groupBy("rid.file").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each file
        if hits:
            names = {"/".join(r["file"].split("/")[-2:]) for r in hits}
            old = [f for f in content["files"] if f in names]
            files = self._add(change(with_row_id(self._scan(content, old))).select(*T.StructType.fromJson(json.loads(content["schema"])).fieldNames()), content)
            self._write_version(number + 1, content | {"files": [f for f in content["files"] if f not in names] + files})
        return self._count(sum(r["n"] for r in hits))

    def delete(self, where: Column | str | None = None) -> DataFrame:
        """Remove the rows for which the condition is true (default: all); one row: their number."""
        hit = F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where
        hit = F.coalesce(hit, F.lit(False))
        return self._rewrite(lambda rows: rows.filter(hit).select("rid"), lambda rows: rows.filter(~hit))

    def delete_rows(self, rids: DataFrame) -> DataFrame:
        """Remove the rows that a DataFrame with a column rid names; ids that are gone are passed over."""
        ids = rids.select("rid").distinct()
        return self._rewrite(lambda rows: rows.select("rid").join(ids, "rid", "left_semi"), lambda rows: rows.join(ids, "rid", "left_anti"))

    def update(self, sets: dict[str, Column | str], where: Column | str | None = None) -> DataFrame:
        """Set columns where the condition is true, from the old values; one row: the number of rows."""
        hit = F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where
        hit = F.coalesce(hit, F.lit(False))
        types = {f.name.lower(): f for f in self.schema}
        new = {}
        for name, value in sets.items():
            if name.lower() not in types:
                raise LookupError(f"the table has no column {name}")
            f = types[name.lower()]
            value = F.expr(value) if isinstance(value, str) else value
            new[f.name] = F.when(hit, value.cast(f.dataType)).otherwise(F.col(f.name))
        return self._rewrite(lambda rows: rows.filter(hit).select("rid"), lambda rows: rows.withColumns(new))
