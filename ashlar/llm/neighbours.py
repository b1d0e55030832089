"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to CURVES groups of a few orthonormal directions.  Every
group gives one Hilbert curve: each coordinate is spread evenly over its range,
shifted by an amount of the curve's own, and cut into cells whose Hilbert index
is the key.  Spark range-partitions (curve, key); a row's rank on a curve puts it
into a block of BLOCK neighbouring rows.  A query visits its own block and those
around it up to the window, on every curve.  What it meets there is ranked by the
exact distance, and the curves' findings are merged.

The window follows from a wanted recall.  For a bounded sample of the queries the
true neighbours are found by comparing them with all rows; where the curves put
these neighbours tells how far a window must reach for the share RECALL of them to
lie in one on some curve.  So vectors with structure get short windows, and where
there is none (the test tables' 64 dimensions) windows grow with the table.

Equal vectors: only the ``k + 1`` smallest ids of each distinct vector are
candidates.  That loses nothing (ties go to smaller ids) and keeps a vector with
very many rows from filling a window; it is cut down before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, ship

CURVES, DIMS, BITS = 16, 8, 6
#: Further bits that order the rows of a cell: a tight cluster may lie in one.
FINE = 7
#: The share of the sampled queries' true neighbours that windows have to hold, and the number of those queries.
RECALL, SAMPLED_QUERIES = 0.98, 256
#: A window reaches this far at least; rows of a block at most.
REACH, BLOCK = 256, 4096
#: Rows from which the coordinates' means and deviations are taken.
SAMPLE = 20_000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Cells (rows, dims), each below 2 ** bits -> their index on the Hilbert curve; bits * dims < 64.

    Works from the coarsest bit: a cell's quadrant fixes how the curve is turned
    and mirrored inside it.  All rows move together.
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        bit, below = 1 << b, (1 << b) - 1
        for i in range(dims):
            upper = (x[i] & bit) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(upper, below, swap)
            x[i] ^= swap
    for i in range(1, dims):  # Gray code across the coordinates
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """The projections, spreads and shifts of all curves for vectors of one dimension."""

    def __init__(self, sample: np.ndarray, dim: int, curves: int = CURVES, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.dims = min(DIMS, dim)
        per_turn = max(1, dim // self.dims)
        parts = []
        while len(parts) < curves:
            turn = np.linalg.qr(rng.normal(size=(dim, per_turn * self.dims)))[0]
            parts += [turn[:, i * self.dims : (i + 1) * self.dims] for i in range(per_turn)]
        self.axes = np.stack(parts[:curves])
        self.shift = rng.random((curves, self.dims))
        self.centre = sample.mean(axis=0) if len(sample) else np.zeros(dim)
        seen = np.einsum("nd,cdk->cnk", sample - self.centre, self.axes) if len(sample) else np.zeros((curves, 1, self.dims))
        self.mean = seen.mean(axis=1)
        self.spread = np.maximum(seen.std(axis=1), 1e-12)

    def keys(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every curve the index of a row's cell, and its index among the 2 ** FINE parts a side of that cell."""
        out, x = [], x - self.centre
        for axes, mean, spread, shift in zip(self.axes, self.mean, self.spread, self.shift):
            z = np.clip((x @ axes - mean) / spread, -30, 30)
            even = 1 / (1 + np.exp(-1.702 * z))  # near the normal distribution function
            at = (0.75 * even + 0.25 * shift) * (1 << BITS)
            cells = np.minimum(at.astype(np.int64), (1 << BITS) - 1)
            parts = np.minimum(((at - cells) * (1 << FINE)).astype(np.int64), (1 << FINE) - 1)
            out.append((hilbert(cells, BITS), hilbert(parts, FINE)))
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = vectors.schema[vector_col].dataType
    own = F.col(vector_col) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType | T.DoubleType) else v
    return vectors.select(F.col(id_col).cast("long").alias("id"), own.alias("v")).filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


class Block:
    """Candidates, and the k nearest of them to queries."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.centre = rows.mean(axis=0)  # distances far from the origin would cancel
        self.near = rows - self.centre
        self.norms, self.sizes = (self.near * self.near).sum(1), np.sqrt((rows * rows).sum(1))

    def nearest(self, q_ids: np.ndarray, q_rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, exact distances) of the k nearest, ties to smaller ids, without the query's own id."""
        for lo in range(0, len(q_ids), 128):
            q = q_rows[lo : lo + 128]
            c = q - self.centre
            norms = (c * c).sum(1)
            d2 = self.norms[None, :] - 2 * (c @ self.near.T) + norms[:, None]
            for i, (qid, line) in enumerate(zip(q_ids[lo : lo + 128], d2)):
                others = np.flatnonzero(self.ids != qid)
                line = line[others]
                # how far rounding may have moved a squared distance
                shift = 1e-15 * (self.sizes[others] + np.sqrt((q[i] * q[i]).sum()))
                slack = 1e-12 * (self.norms[others] + norms[i]) + 2 * np.sqrt(np.maximum(line, 0)) * shift + shift * shift
                if len(line) > k:
                    others = others[line - slack <= np.partition(line + slack, k - 1)[k - 1]]
                exact = np.sqrt(((self.rows[others] - q[i]) ** 2).sum(1))
                order = np.lexsort((self.ids[others], exact))[:k]
                yield qid, self.ids[others][order], exact[order]


def _found(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    queries = np.repeat(np.array([q for q, _, _ in rows], dtype=np.int64), [len(i) for _, i, _ in rows])
    return pa.RecordBatch.from_arrays([pa.array(queries), pa.array(np.concatenate([i for _, i, _ in rows])), pa.array(np.concatenate([s for _, _, s in rows]))], ["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def _search(dim: int, k: int):
    """Rows sorted by (curve, block), candidates before queries -> each query's k nearest of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, c_ids, c_rows, block, found = None, [], [], None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_numpy().astype(np.int64) * (1 << 40) + batch.column(1).to_numpy()
            role, ids, rows = batch.column(2).to_numpy(), batch.column(3).to_numpy(), _matrix(batch.column(4), dim)
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (role[1:] != role[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(names)]):
                if names[a] != group:
                    group, c_ids, c_rows, block = names[a], [], [], None
                if role[a] == 0:
                    c_ids.append(ids[a:b])
                    c_rows.append(rows[a:b])
                elif c_ids:
                    if block is None:
                        block = Block(np.concatenate(c_ids), np.concatenate(c_rows))
                    found += block.nearest(ids[a:b], rows[a:b], k)
            if len(found) > 2000:
                yield _found(found)
                found = []
        if found:
            yield _found(found)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k smallest of each query; an id's distance is that of its nearest vector."""
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_search(candidates: DataFrame, q_ids: np.ndarray, q_rows: np.ndarray, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of a bounded set of queries against all candidates (id, v), in blocks."""
    dim = q_rows.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []  # of each query, over all of the task's rows
        for batch in batches:
            if not batch.num_rows:
                continue
            found = list(Block(batch.column(0).to_numpy(), _matrix(batch.column(1), dim)).nearest(q_ids, q_rows, k))
            for at, (q, ids, scores) in enumerate(found if best else []):
                ids, scores = np.concatenate([best[at][1], ids]), np.concatenate([best[at][2], scores])
                order = np.lexsort((ids, scores))[:k]
                found[at] = q, ids[order], scores[order]
            best = found
        if best:
            yield _found(best)

    return _best(candidates.select("id", "v").mapInArrow(run, FOUND), k)


def _reach(members: DataFrame, ranked: DataFrame, dim: int, k: int, recall: float, m: int) -> int:
    """How many rows on either side a window needs, so that the share recall of sampled true neighbours lies in a window of one curve at least."""
    asked = members.filter("query").orderBy(F.xxhash64("id"), "id").limit(SAMPLED_QUERIES).select("id", "v").toPandas()
    if not len(asked):
        return REACH
    truth = exact_search(members.filter("candidate"), asked["id"].to_numpy(np.int64), np.array(asked["v"].tolist(), dtype=np.float64).reshape(-1, dim), k)
    truth = checkpoint(truth.select("query_id", "vec_id"))  # SAMPLED_QUERIES x k rows at most
    there = ranked.join(F.broadcast(truth), F.col("id") == F.col("vec_id")).select("query_id", "vec_id", "curve", F.col("rank").alias("at"))
    here = ranked.join(F.broadcast(truth.select("query_id").distinct()), F.col("id") == F.col("query_id")).select("query_id", "curve", "rank")
    apart = there.join(here, ["query_id", "curve"]).groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("at") - F.col("rank"))).alias("apart"))
    far = np.sort(apart.toPandas()["apart"].to_numpy(np.int64))
    return max(REACH, min(m, int(far[min(len(far) - 1, math.ceil(recall * len(far)))]))) if len(far) else REACH


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, curves: int = CURVES, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row, Euclidean, nearest first, ties to smaller ids.

    is_query is a condition on the column ``id``.  Vectors that are null, zero, or
    hold null or non-finite components, and rows without an id, take no part; nor
    do vectors whose length isn't the commonest one (ties: the shortest).  Rows
    with the query's own id are no candidates; repeated rows count once.  Of an id
    with several vectors the distance is the smallest between any of its vectors
    and any of the other's.  An empty table gives an empty result.  Other columns
    are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = _valid(vectors, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common["dim"]
    rows = rows.filter(F.size("v") == dim).dropDuplicates(["id", "v"])
    query = is_query
    same = Window.partitionBy("v").orderBy("id")
    first = rows.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).select("id", "v", F.lit(True).alias("candidate"))
    # queries that are no candidates themselves: their vector has k + 1 smaller ids
    rest = rows.filter(query).select("id", "v", F.lit(False).alias("candidate"))
    members = checkpoint(first.union(rest).groupBy("id", "v").agg(F.max("candidate").alias("candidate")).withColumn("query", query))
    m = members.count()
    seen = members.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"].tolist()
    model = Curves(np.array(seen, dtype=np.float64).reshape(-1, dim), dim, curves)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, (key, fine) in enumerate(model.keys(_matrix(batch.column(1), dim))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, dtype=np.int32)), pa.array(key), pa.array(fine), batch.column(0)], ["curve", "key", "fine", "id"])

    keyed = members.select("id", "v").mapInArrow(keys, "curve int, key long, fine long, id long")
    order = ["curve", "key", "fine", "id"]
    ordered = checkpoint(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("curve", "id"))
    # a row's rank: rows of earlier partitions, and its place in its own; every curve has m rows
    placed = ordered.withColumn("at", F.monotonically_increasing_id()).withColumns({"part": F.shiftright("at", 33), "place": F.col("at").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("part").count()
    before = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = placed.join(F.broadcast(before), F.col("part") == F.col("p"))  # a row for each partition
    ranked = ranked.select("curve", "id", F.pmod(F.col("before") + F.col("place"), F.lit(m)).alias("rank"))
    reach = _reach(members, ranked, dim, k, recall, m)
    block = min(reach, BLOCK)
    n_blocks, around = max(1, m // block), math.ceil(reach / block)
    ranked = ranked.withColumn("block", F.least(F.floor(F.col("rank") / block), F.lit(n_blocks - 1)).cast("long"))
    located = ranked.select("curve", "block", "id").join(members, "id")
    low = F.greatest(F.least(F.col("block") - around, F.lit(n_blocks - 1 - 2 * around)), F.lit(0))
    high = F.least(F.greatest(F.col("block") + around, F.lit(2 * around)), F.lit(n_blocks - 1))
    own = located.filter("candidate").select("curve", "block", F.lit(0).alias("role"), "id", "v")
    asks = located.filter("query").select("curve", F.explode(F.sequence(low, high)).alias("block"), F.lit(1).alias("role"), "id", "v")
    near = own.union(asks).repartition("curve", "block").sortWithinPartitions("curve", "block", "role")
    return _best(near.mapInArrow(_search(dim, k), FOUND), k)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of every hundredth vector of embeddings; edge cases as in ``search``."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)
