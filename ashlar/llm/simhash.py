"""SimHash near-dedup with bit-sliced comparison.

Fingerprints come from word shingles.  Only distinct fingerprints are compared:
copies of a text meet in an aggregation that is combined before its shuffle.
Fingerprints are dealt to buckets by parts of their bits, every bucket is
compared by the bit-sliced kernel (``bitslice``), and a bucket hands on the links
that join trees of its own spanning forest, at most one for each fingerprint
instead of one for each pair.  The links' connected components are the groups.

Two ways of dealing, both linear in the rows that they send:

* ``exact_keys`` (small radius): the bits are split into radius + 1 parts, and
  the rest again, so that two fingerprints within the radius share one key at
  least.  No link is lost.
* ``sampled_keys`` (wide fingerprints, large radius): random selections of bits,
  as many as keep the chance to miss a pair under a stated bound.

Buckets of more than TILE fingerprints are cut into tiles and each pair of tiles
is a bucket of its own, so a hot bucket is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitslice import Forest, close_pairs
from .common import checkpoint, hand_back, ship
from .components import components

SEED = 42
#: Shingles whose bits are counted at once, and fingerprints of a bucket's tile.
CHUNK, TILE = 1 << 14, 1 << 14


def _hashes(words: list[bytes], k: int, at: int) -> np.ndarray:
    """XXH64 (seed 42) of the CHUNK shingles from word at on; fewer than k words: one shingle of all of them."""
    part = words[at : at + CHUNK + k - 1]
    shingles = map(b" ".join, zip(*(part[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The hashes of the distinct shingles of a text, sorted; none if it has no words."""
    words = text.lower().split()
    return np.unique(np.concatenate([_hashes(words, k, at) for at in range(0, max(1, len(words) - k + 1), CHUNK)])) if words else np.zeros(0, dtype=np.uint64)


def _bit_counts(h: np.ndarray, n_bits: int) -> np.ndarray:
    """How many of the hashes have each of n_bits bits set."""
    if n_bits > 64:
        more = np.arange(n_bits // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = h[:, None] + more[None, :]
        h[:, 1:] = (h[:, 1:] ^ (h[:, 1:] >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h[:, 1:] = (h[:, 1:] ^ (h[:, 1:] >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h[:, 1:] ^= h[:, 1:] >> np.uint64(31)
    return np.unpackbits(h.view(np.uint8).reshape(-1, n_bits // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)


def fingerprint(text: bytes, k: int, n_bits: int) -> bytes:
    """n_bits / 8 bytes, least significant first; a bit is set if it is in over half of the shingles' hashes.

    The first 64 bits of a shingle's hash are its XXH64 (seed 42), further words
    are derived from that by a multiplicative mix.  Fewer than k words: one
    shingle of all of them; no words: zero.
    """
    words = text.lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return bytes(n_bits // 8)
    counts = np.zeros(n_bits, dtype=np.int64)
    n = max(1, len(words) - k + 1)
    for at in range(0, n, CHUNK):
        counts += _bit_counts(_hashes(words, k, at), n_bits)
    return np.packbits(2 * counts > n, bitorder="little").tobytes()


def set_fingerprint(shingles: np.ndarray, n_bits: int) -> bytes:
    """The fingerprint of a set of shingles: each counts once, however often a text has it."""
    counts = np.zeros(n_bits, dtype=np.int64)
    for at in range(0, len(shingles), CHUNK):
        counts += _bit_counts(shingles[at : at + CHUNK], n_bits)
    return np.packbits(2 * counts > len(shingles), bitorder="little").tobytes()


def _bytes(texts: pa.Array) -> pa.Array:
    return texts.cast(pa.binary() if texts.type == pa.string() else pa.large_binary())


def fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int, n_bits: int) -> DataFrame:
    """(id, print binary) for every row; a null text is empty and has fingerprint zero."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprint(t.as_py() or b"", k, n_bits) for t in _bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "print"])

    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("print", T.BinaryType())]))


def _bit_ranges(parts: list[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    """Split a list of bit ranges (start, length) into n such lists of nearly equal length."""
    total = sum(length for _, length in parts)
    out, rest, left = [], list(parts), total
    for i in range(n):
        want = left // (n - i)
        left -= want
        own = []
        while want:
            start, length = rest[0]
            cut = min(want, length)
            own.append((start, cut))
            want -= cut
            rest[0] = (start + cut, length - cut)
            if not rest[0][1]:
                rest.pop(0)
        out.append(own)
    return out


def exact_keys(n_bits: int, radius: int) -> list[list[tuple[int, int]]]:
    """Bit selections, one of which is equal in any two fingerprints within the radius (pigeonhole, twice)."""
    out = []
    first = _bit_ranges([(0, n_bits)], radius + 1)
    for i, own in enumerate(first):
        others = [r for j, part in enumerate(first) if j != i for r in part]
        out += [own + more for more in _bit_ranges(others, radius + 1)]
    return out


def sampled_keys(n_bits: int, width: int, count: int, seed: int = 11) -> list[list[tuple[int, int]]]:
    """count random selections of width bits.

    Two fingerprints that differ in a share d of their bits agree on a selection
    with chance about (1 - d) ^ width, and miss each other in all of them with
    chance (1 - (1 - d) ^ width) ^ count.
    """
    rng = np.random.default_rng(seed)
    return [[(int(p), 1) for p in np.sort(rng.choice(n_bits, width, replace=False))] for _ in range(count)]


def _deal(prints: DataFrame, keys: list[list[tuple[int, int]]]) -> DataFrame:
    """(bucket long, node, print): a row for each fingerprint and key; a bucket's name holds its table's number and the selected bits."""
    ship(prints.sparkSession)
    named = max(1, (len(keys) - 1).bit_length())
    if named + max(sum(length for _, length in ranges) for ranges in keys) > 64:
        raise ValueError("a bucket's name would need more than 64 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = _words_of(batch.column(1))
            for t, ranges in enumerate(keys):
                key, shift = np.full(n, t, dtype=np.uint64), 0
                value = np.zeros(n, dtype=np.uint64)
                for start, length in ranges:
                    for at in range(start, start + length):
                        value |= ((rows[:, at >> 6] >> np.uint64(at & 63)) & np.uint64(1)) << np.uint64(shift)
                        shift += 1
                bucket = (key << np.uint64(64 - named)) | value
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), batch.column(0), batch.column(1)], ["bucket", "node", "print"])

    return prints.select("node", "print").mapInArrow(run, "bucket long, node long, print binary")


def _tiles(dealt: DataFrame, tiles: Column | None = None) -> DataFrame:
    """dealt with columns part and tile: buckets over TILE rows, or of more than one of the given tiles, become one bucket for each pair of tiles."""
    tiles = F.ceil(F.count("*") / TILE) if tiles is None else tiles
    hot = checkpoint(dealt.groupBy(F.col("bucket").alias("hot")).agg(tiles.cast("int").alias("tiles")).filter("tiles > 1"))
    if hot.isEmpty():
        return dealt.withColumns({"part": F.lit(0), "tile": F.lit(0).cast("long")})
    rows = dealt.join(F.broadcast(hot) if hot.count() <= 100_000 else hot, F.col("bucket") == F.col("hot"), "left")
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda other: F.least(own, other).cast("long") * F.lit(1 << 31) + F.greatest(own, other).cast("long"))
    rows = rows.withColumn("part", F.coalesce(own, F.lit(0)))
    return rows.withColumn("tile", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs))).drop("hot", "tiles")


def alike(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sets of shingles (sorted 64-bit hashes) have this Jaccard similarity or more."""
    m, n = sorted((len(a) // 8, len(b) // 8))
    if m < similarity * n - 1e-9:
        return False
    both = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
    return both >= similarity * (m + n - both) - 1e-9


def _words_of(prints: pa.Array) -> np.ndarray:
    """Fingerprints of one length as [rows, words] of 64-bit words."""
    ends = np.frombuffer(prints.buffers()[1], np.int32)[prints.offset : prints.offset + len(prints) + 1]
    return np.frombuffer(prints.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64).reshape(len(prints), -1)


def _compare(radius: int, similarity: float | None = None):
    """Links that span the groups of each (bucket, tile): of prints within the radius, and with a similarity of sets that have it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links(parts):
            columns = [np.concatenate(x) for x in zip(*parts)]
            bucket, tile = columns[:2]
            same = (bucket[1:] == bucket[:-1]) & (tile[1:] == tile[:-1])
            some = np.r_[False, same] | np.r_[same, False]  # a row alone in its bucket has no partner
            bucket, tile, node, prints, *more = (c[some] for c in columns)
            if not len(bucket):
                return
            group = np.cumsum(np.r_[False, (bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1])])
            forest, u, v = Forest(len(bucket)), [], []
            agree = None
            if more:
                sets, part = more
                agree = lambda i, j: np.array([alike(sets[a], sets[b], similarity) for a, b in zip(i, j)], dtype=bool)
            for i, j in close_pairs(group, prints, radius, forest.tree):
                if more:  # pairs of one part meet in that part's own tile
                    other = (part[i] != part[j]) | (tile[i] >> 31 == tile[i] & ((1 << 31) - 1))
                    i, j = i[other], j[other]
                i, j = forest.join(i, j, agree)
                u.append(node[i])
                v.append(node[j])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            more = ()
            if similarity is not None:
                sets = np.empty(batch.num_rows, dtype=object)
                sets[:] = batch.column(4).to_pylist()
                more = sets, batch.column(5).to_numpy()
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), _words_of(batch.column(3)), *more))
            # hand on whole buckets; the last one may go on in the next batch
            b, t = held[-1][0], held[-1][1]
            last = np.flatnonzero((b != b[-1]) | (t != t[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                head = [*held[:-1], tuple(x[:cut] for x in held[-1])]
                held = [tuple(x[cut:] for x in held[-1])]
                yield from links(head)
        if held:
            yield from links(held)
        hand_back()

    return run


def links(prints: DataFrame, radius: int, keys: list[list[tuple[int, int]]]) -> DataFrame:
    """prints (node long, print; distinct prints) -> (u, v): links that span the groups of fingerprints within the radius."""
    dealt = _tiles(_deal(prints, keys))
    ordered = dealt.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile").select("bucket", "tile", "node", "print")
    return ordered.mapInArrow(_compare(radius), "u long, v long").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, n_bits: int = 64, radius: int = 3, keys: list[list[tuple[int, int]]] | None = None) -> DataFrame:
    """(id, print, component_id) for every row of docs, ids integers.

    Rows whose fingerprints differ in radius bits or fewer are linked, and
    component_id is the smallest id reachable.  Rows without words (null and empty
    texts) have fingerprint zero and are linked like any other.  Rows with a null
    id get a fingerprint; their component is that of their fingerprint, null if
    no row of it has an id.  Repeated rows are in one component.  Other columns
    are not read.  An empty table gives an empty result.
    """
    rows = checkpoint(fingerprints(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, k, n_bits))
    prints = checkpoint(rows.groupBy("print").agg(F.min("id").alias("node")))
    found = components(links(prints.filter("node IS NOT NULL"), radius, exact_keys(n_bits, radius) if keys is None else keys))
    named = prints.join(found, "node", "left").select(F.col("print").alias("p"), F.coalesce("root", "node").alias("component_id"))
    return rows.join(named, F.col("print") == F.col("p")).select("id", "print", "component_id")


#: Near copies for the pipeline: five-word shingles, similarity of 0.8 or more.
WIDE_BITS = 384


#: The chance to miss a pair of just the wanted similarity.
MISS = 0.01


def share_of(similarity: float) -> float:
    """The share of bits in which sets of this Jaccard similarity differ: their cosine is about 2s / (1 + s)."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_of(similarity: float, n_bits: int, deviations: float = 2.5) -> int:
    """The Hamming radius that finds sets of this similarity: some standard deviations above the expected number of bits."""
    p = share_of(similarity)
    return round(n_bits * p + deviations * math.sqrt(n_bits * p * (1 - p)))


def keys_for(n: int, similarity: float, n_bits: int) -> list[list[tuple[int, int]]]:
    """Selections for n fingerprints: so wide that a bucket has about 256 unrelated ones, so many that MISS holds."""
    width = max(8, math.ceil(math.log2(max(n, 1))) - 8)
    hit = (1 - share_of(similarity)) ** width
    return sampled_keys(n_bits, width, math.ceil(math.log(MISS) / math.log(1 - hit)))


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast in joins if it has few rows."""
    return F.broadcast(df) if df.count() <= 100_000 else df


def _nodes(rows: DataFrame, k: int, n_bits: int) -> DataFrame:
    """rows (id, h, text) -> (id, h, node, print): node names the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, prints = [], []
            for t in _bytes(batch.column(2)):
                shingles = shingle_set(t.as_py(), k)
                names.append(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))
                prints.append(set_fingerprint(shingles, n_bits))
            node = pa.array(np.array(names, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, pa.array(prints, pa.binary())], ["id", "h", "node", "print"])

    return rows.mapInArrow(run, "id long, h long, node long, print binary")


def _with_sets(rows: DataFrame, k: int) -> DataFrame:
    """rows (bucket, node, print, text) -> the same with the set of shingles in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), k).tobytes() for t in _bytes(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], ["bucket", "node", "print", "shingles"])

    return rows.mapInArrow(run, "bucket long, node long, print binary, shingles binary")


#: Tiles of a group of proposed copies: of SPREAD sets up to 16 tiles, and no more than TILE sets or TILE_BYTES each.
SPREAD, TILE_BYTES = 128, 1 << 25


def verified_links(rows: DataFrame, nodes: DataFrame, k: int, similarity: float, radius: int, keys: list[list[tuple[int, int]]]) -> DataFrame:
    """(u, v): links that span the groups of nodes whose sets of shingles have the similarity.

    Fingerprints within the radius propose groups.  In each group every pair
    within the radius that no link joins yet is compared by the whole sets, so a
    proposed link that falls doesn't hide another.
    """
    found = components(links(nodes, radius, keys))
    members = found.union(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "bucket")
    picked = checkpoint(nodes.join(members, "node").select("bucket", "node", "print", F.col("first.id").alias("i"), F.col("first.h").alias("t")))
    texts = rows.join(_small(picked), (F.col("id") == F.col("i")) & (F.col("h") == F.col("t"))).select("bucket", "node", "print", "text")
    sets = checkpoint(_with_sets(texts, k).dropDuplicates(["node"]))
    few = F.when(F.count("*") > 2 * SPREAD, F.least(F.ceil(F.count("*") / SPREAD), F.lit(16))).otherwise(1)
    tiled = _tiles(sets, F.greatest(few, F.ceil(F.count("*") / TILE), F.ceil(F.sum(F.length("shingles")) / TILE_BYTES)))
    ordered = tiled.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile").select("bucket", "tile", "node", "print", "shingles", "part")
    return ordered.mapInArrow(_compare(radius, similarity), "u long, v long").distinct()


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, n_bits: int = WIDE_BITS) -> DataFrame:
    """docs with one row, that of the smallest id, of each group of near copies.

    Two texts are linked if the Jaccard similarity of their sets of k-word
    shingles is the wanted one or more: wide fingerprints propose pairs, the whole
    sets decide.  Documents without words have no shingles: they are left alone.
    Rows with a null id are left alone.  If one id has several texts, only the row
    of the text that is a copy goes; of rows with a group's smallest id all stay.
    """
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    words = F.coalesce(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)) & F.col(id_col).isNotNull()
    rows = docs.filter(words).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    named = checkpoint(_nodes(rows, k, n_bits))
    nodes = checkpoint(named.groupBy("node").agg(F.first("print").alias("print"), F.min(F.struct("id", "h")).alias("first")))
    found = checkpoint(components(verified_links(rows, nodes, k, similarity, radius_of(similarity, n_bits), keys_for(docs.count(), similarity, n_bits))))
    # the smallest id of each group; groups of one node have no root
    ids = nodes.select("node", F.col("first.id").alias("low"))
    tied = checkpoint(ids.join(found.union(found.select(F.col("root").alias("node"), "root").distinct()), "node"))
    least = checkpoint(tied.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("least")))
    kept = checkpoint(tied.join(_small(least), F.col("root") == F.col("r")).select("node", "least"))
    kept = ids.join(kept, "node", "left").select("node", F.coalesce("least", "low").alias("kept"))
    copies = named.join(kept, "node").filter("id <> kept").select(F.col("id").alias("__copy"), F.col("h").alias("__text")).distinct()
    return docs.join(copies, (F.col(id_col) == F.col("__copy")) & (F.xxhash64(text) == F.col("__text")), "left_anti")


def hex_print() -> Column:
    """The 64-bit fingerprint as 16 hex digits, most significant first."""
    return F.lower(F.concat(*[F.hex(F.substring("print", i, 1)) for i in range(8, 0, -1)]))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id for every row of documents; edge cases as in ``groups``."""
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, n_bits=64, radius=3)
    return found.select(F.col("id").alias("doc_id"), hex_print().alias("fingerprint"), "component_id")
