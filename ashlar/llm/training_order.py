"""Token-ID output in training order.

Sequences of a fixed number of token ids are given global slots by a keyed
Feistel permutation with cycle-walking.  A slot's shard is its quotient by the
shard's length, so the range partitions are known beforehand and every sequence
moves once, straight to its shard.  A shard is one binary file of records of a
fixed stride:

    slot u64 | first id i64 | sequence within its partition u32 | ids used u32 | ids | end mark

(little-endian), so slot s stands in shard s div length at (s mod length) x stride
and a reader resumes anywhere; it verifies each record's slot and end mark.
Files are written by Spark's own committer, on any file system that Spark knows:
an attempt that dies leaves nothing, and a retry writes the same bytes.

The token stream of a partition (documents in order, each followed by an end id)
is cut into sequences without gaps; the last one of a partition is padded.
How many sequences each partition has follows from a scan that only counts, so
the permutation's domain is known before any ids are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_dir, ship, small_batches
from .feistel import permute

#: The byte vocabulary: ids 0 to 255 are UTF-8's bytes, of which these two never occur in a text.
END, PAD = 0xFF, 0xFE
HEADER = np.dtype([("slot", "<u8"), ("first_id", "<i8"), ("place", "<u4"), ("used", "<u4")])
MARK = b"\n"
SEQUENCE, SHARD = 2048, 8192


def stride(sequence: int = SEQUENCE, width: int = 1) -> int:
    return HEADER.itemsize + sequence * width + len(MARK)


def _rows(docs: DataFrame, id_col: str, text_col: str | None, ids_col: str | None, width: int) -> DataFrame:
    """(id, ids as little-endian bytes): the UTF-8 bytes of a text, or the numbers of an array column."""
    if ids_col is None:
        ids = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    else:
        ids = F.coalesce(F.col(ids_col).cast("array<long>"), F.array().cast("array<long>"))
    return docs.select(F.col(id_col).cast("long").alias("id"), ids.alias("ids"))


def sequences(docs: DataFrame, key: int, id_col: str = "doc_id", text_col: str = "text", ids_col: str | None = None, width: int = 1, end: int = END, pad: int = PAD, sequence: int = SEQUENCE) -> tuple[DataFrame, int]:
    """((slot, first_id, place, used, ids), number of sequences) of docs.

    first_id is the id of the document in which the sequence begins (-1 for
    null), place its number within its partition, used the ids that aren't
    padding.  A null or empty document gives its end id alone.  docs must give
    the same rows in the same partitions when it is read twice, as a scan of
    files does; a partition that doesn't raises instead of writing wrong slots.
    Repeated rows are tokens like any other; an empty table has no sequences.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = _rows(docs, id_col, text_col, ids_col, width)
    length = F.octet_length("ids") if ids_col is None else F.size("ids")
    counts = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(length.cast("long") + 1).alias("n")).collect()  # a row for each partition
    n_of = {r["part"]: -(-r["n"] // sequence) for r in counts}
    base, n = {}, 0
    for part in sorted(n_of):
        base[part] = n
        n += n_of[part]
    dtype = np.dtype(f"<u{width}")
    fields = "slot long, first_id long, place int, used int, ids binary"
    if not n:
        return spark.createDataFrame([], fields), 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held = None, 0, np.zeros(0, dtype)
        # where the documents that held and the batch hold begin in them, and their ids
        starts: list[int] = []
        owners: list[int] = []

        def give(ids: np.ndarray, first: list[int], used: list[int]) -> pa.RecordBatch:
            nonlocal place
            k = len(first)
            if place + k > n_of.get(part, 0):
                raise RuntimeError("a partition has other rows than when it was counted")
            index = base[part] + place + np.arange(k)
            slots = permute(index.astype(np.uint64), n, key).astype(np.int64)
            payload = [ids[i * sequence : (i + 1) * sequence].tobytes() for i in range(k)]
            places = np.arange(place, place + k, dtype=np.int32)
            place += k
            return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(first, pa.int64()), pa.array(places), pa.array(used, pa.int32()), pa.array(payload, pa.binary())], ["slot", "first_id", "place", "used", "ids"])

        for batch in small_batches(batches):
            if part is None:
                part = batch.column(2)[0].as_py()
            pieces, at = [held], len(held)
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces.append(np.frombuffer(ids, np.uint8).astype(dtype) if ids_col is None else np.array(ids, dtype=dtype))
                pieces.append(np.array([end], dtype))
                starts.append(at)
                owners.append(-1 if doc is None else doc)
                at += len(pieces[-2]) + 1
            stream = np.concatenate(pieces)
            full = len(stream) // sequence
            if full:
                first = np.searchsorted(starts, np.arange(full) * sequence, side="right") - 1
                yield give(stream, [owners[i] for i in first], [sequence] * full)
            held = stream[full * sequence :].copy()
            cutoff = full * sequence
            keep = int(np.searchsorted(starts, cutoff, side="right")) - 1
            owners, starts = owners[keep:], [max(0, s - cutoff) for s in starts[keep:]]
        if len(held):
            used = len(held)
            yield give(np.concatenate([held, np.full(sequence - used, pad, dtype)]), [owners[0]], [used])
        if part is not None and place != n_of[part]:
            raise RuntimeError("a partition has other rows than when it was counted")

    return rows.withColumn("part", F.spark_partition_id()).mapInArrow(cut, fields), n


def write_shards(found: DataFrame, n: int, path: str, sequence: int = SEQUENCE, width: int = 1, shard: int = SHARD) -> None:
    """Write the shards below path: part-00000 has slots 0 to shard - 1, and so on."""
    spark = found.sparkSession

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            head = np.zeros(batch.num_rows, HEADER)
            for i, name in enumerate(HEADER.names):
                head[name] = batch.column(i).to_numpy()
            out = [h.tobytes() + ids for h, ids in zip(head, batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["slot", "record"])

    shards = max(1, -(-n // shard))
    packed = found.mapInArrow(records, "slot long, record binary")
    dealt = packed.repartitionById(shards, F.floor(F.col("slot") / shard).cast("int")).sortWithinPartitions("slot")
    # Spark's line writer hands the bytes on as they are; the line end is the record's end mark
    dealt.select(F.col("record").cast("string").alias("value")).write.mode("overwrite").option("lineSep", MARK.decode()).option("compression", "none").text(path)


def read_shards(spark: SparkSession, path: str, sequence: int = SEQUENCE, width: int = 1, from_slot: int = 0) -> DataFrame:
    """(slot, first_id, place, used, ids) of the shards below path, from a slot on; damaged records raise."""
    ship(spark)
    size = stride(sequence, width)

    def parse(records: Iterator[bytes]) -> Iterator[tuple]:
        for record in records:
            head = np.frombuffer(record[: HEADER.itemsize], HEADER)[0]
            if len(record) != size or record[-1:] != MARK:
                raise ValueError("a record's end mark is missing")
            if head["slot"] >= from_slot:
                yield int(head["slot"]), int(head["first_id"]), int(head["place"]), int(head["used"]), bytearray(record[HEADER.itemsize : -1])

    rows = spark.sparkContext.binaryRecords(f"{path}/part-*", size).mapPartitions(parse)
    return spark.createDataFrame(rows, "slot long, first_id long, place int, used int, ids binary", verifySchema=False)


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the shards of all documents (UTF-8 bytes as ids) and read them back: one row for each slot."""
    found, n = sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"), key=20)
    path = own_dir(spark)
    if n:
        write_shards(found, n, path)
        found = read_shards(spark, path)
    return found.select(
        "slot",
        F.floor(F.col("slot") / SHARD).cast("long").alias("shard"),
        (F.pmod("slot", F.lit(SHARD)) * stride()).cast("long").alias("offset"),
        F.col("first_id").alias("first_doc_id"),
        F.col("used").cast("long").alias("used"),
        F.sha2("ids", 256).alias("ids_sha256"),
    )
