"""Mixing sources to target weights.

The words of each source form one stream (documents in a fixed order), which is
packed into blocks of fixed length.  The mix is a row of output shards with a
fixed number of slots.  Each shard draws how many of its slots each source gets;
the j-th slot of a source then takes block ``permutation(j mod blocks)`` of it,
with another keyed permutation for every pass over the source, and the blocks'
words are found by a join on (source, block).

The draw is a residual multinomial: every shard gives each source the whole part
of its expected count and draws the slots that remain from the fractional parts.
That keeps the expectation of a plain multinomial, with a deviation of a few
blocks for a source in the whole mix (it grows with the root of the number of
shards).  A source never gives more than ``cap`` passes: what is drawn beyond is
drawn anew among the others.

Scale: one row for each source reaches the driver.  The place of a document in
its source's stream is a prefix sum in two levels (1,024 hash chunks a source,
then inside the chunk), so a source with a third of all rows is spread over 1,024
groups.  Slots are made in parallel by groups of GROUP shards; a slot's place among
its source's slots is a prefix sum over the groups' counts, one row for a group and
source.  Blocks and slots join on (source, block), where no key has more rows than
``cap`` slots and the documents of one block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, shuffle_partitions, ship
from .feistel import permute

#: Chunks of a source's stream; fixed, so that a rerun under other settings lays out the same blocks.
CHUNKS = 1024
#: Shards that are drawn together.
GROUP = 16
#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 200


def fill_targets(sizes: Sequence[int], weights: Sequence[float], cap: float) -> list[float]:
    """Share sum(sizes) by weight; no target is above cap times its size, the excess is shared anew by weight."""
    targets = [0.0] * len(sizes)
    rest, open_ = float(sum(sizes)), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        share = rest / sum(weights[i] for i in open_)
        over = [i for i in open_ if share * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = share * weights[i]
            break
        for i in over:
            targets[i] = cap * float(sizes[i])
            rest -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


class Dealer:
    """The draw: how many slots of each shard every source gets, the same whenever it is asked."""

    def __init__(self, n_slots: int, shard_slots: int, quota: np.ndarray, seed: int) -> None:
        self.n_slots, self.shard_slots, self.quota, self.seed = n_slots, shard_slots, quota, seed
        self.shards = -(-n_slots // shard_slots)
        self.groups = -(-self.shards // GROUP)

    def counts(self, group: int) -> np.ndarray:
        """[shards of the group, sources] slots: the whole part of each expected count, the rest multinomial by the fractional parts."""
        out = []
        for shard in range(group * GROUP, min((group + 1) * GROUP, self.shards)):
            slots = min(self.shard_slots, self.n_slots - shard * self.shard_slots)
            expected = slots * self.quota / self.quota.sum()
            counts = np.floor(expected + 1e-9).astype(np.int64)
            part = np.maximum(expected - counts, 0)
            left = int(slots - counts.sum())
            if left > 0:
                counts += np.random.default_rng([self.seed, shard]).multinomial(left, part / part.sum())
            out.append(counts)
        return np.array(out).reshape(-1, len(self.quota))


class Redraw:
    """Moves the slots that a source drew beyond its room to sources that have room, drawn by quota; a few numbers for each source."""

    def __init__(self, drawn: np.ndarray, room: np.ndarray, quota: np.ndarray, seed: int) -> None:
        self.drawn, self.room, self.seed = drawn, room, seed
        over = np.maximum(drawn - room, 0)
        self.first = np.cumsum(over) - over  # a source's surplus slots, numbered over all sources
        self.n = int(over.sum())
        free, more = np.maximum(room - drawn, 0), np.zeros_like(drawn)
        rng = np.random.default_rng([seed, 1 << 40])
        left = min(self.n, int(free.sum()))
        while left:
            share = np.where(free > more, np.maximum(quota, 1e-12), 0.0)
            more = np.minimum(more + rng.multinomial(left, share / share.sum()), free)
            left = min(self.n, int(free.sum())) - int(more.sum())
        self.ends = np.cumsum(more)
        self.begins = self.ends - more

    def __call__(self, source: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        over = np.flatnonzero(j >= self.room[source])
        if not len(over):
            return source, j
        number = self.first[source[over]] + j[over] - self.room[source[over]]
        place = permute(number.astype(np.uint64), self.n, self.seed).astype(np.int64)
        to = np.searchsorted(self.ends, place, side="right")
        source, j = source.copy(), j.copy()
        found = to < len(self.ends)  # else no source has room left
        source[over[found]], j[over[found]] = to[found], self.drawn[to[found]] + place[found] - self.begins[to[found]]
        keep = np.ones(len(source), dtype=bool)
        keep[over[~found]] = False
        return source[keep], j[keep]


class Mix:
    """A mix of docs: ``documents`` (sizes, targets, stream places), ``blocks``, ``slots`` and ``taken``.

    Sources come in code-point order, null last, and weigh ``weights``, repeating.
    A null text has no words; documents without words take no part and get 0.
    Repeated rows are documents of their own.  An empty table gives empty results.
    Only the three named columns are read, so other columns can't clash.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), cap: int = 3, block_words: int = 64, shard_slots: int = 4096, seed: int = 1) -> None:
        self.spark: SparkSession = docs.sparkSession
        ship(self.spark)
        self.cap, self.block_words, self.shard_slots, self.seed = cap, block_words, shard_slots, seed
        text = F.col(text_col)
        self.sized = checkpoint(
            docs.select(
                F.col(id_col).alias("doc_id"),
                F.col(source_col).cast("string").alias("source"),
                F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                F.xxhash64(text).alias("text_hash"),
            ).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(CHUNKS)).cast("int"))
        )
        sums = self.sized.groupBy("source").agg(F.sum("size").alias("size")).collect()  # a row for each source
        self.sources = sorted(((r["source"], int(r["size"])) for r in sums), key=lambda x: (x[0] is None, x[0] or ""))
        sizes = [s for _, s in self.sources]
        self.targets = fill_targets(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], cap)
        self.n_blocks = [-(-s // block_words) for s in sizes]
        # as many slots as bring the target, at the source's mean words a block
        self.quota = [t * n / s if s else 0.0 for t, n, s in zip(self.targets, self.n_blocks, sizes)]
        self.n_slots = round(sum(self.quota))

    def _few(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if len(self.sources) <= BROADCAST_SOURCES else df

    @property
    def source_table(self) -> DataFrame:
        rows = [(i, name, size, float(t), n) for i, ((name, size), t, n) in enumerate(zip(self.sources, self.targets, self.n_blocks))]
        return self.spark.createDataFrame(rows, "source_no int, source_name string, source_size long, target double, n_blocks long")

    @property
    def documents(self) -> DataFrame:
        """doc_id, text_hash, size, source, source_no, source_size, target, and start: its first word's place in the source's stream; (source_no, chunk, place) names the row."""
        by_chunk = self.sized.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
        stream = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        base = by_chunk.select(F.col("source").alias("b_source"), F.col("chunk").alias("b_chunk"), F.coalesce(F.sum("words").over(stream), F.lit(0)).alias("base"))
        inside = Window.partitionBy("source", "chunk").orderBy("doc_id", "text_hash")
        placed = self.sized.withColumns(
            {
                "before": F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                "place": F.row_number().over(inside),
            }
        )
        placed = placed.join(self._few(base), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("chunk") == F.col("b_chunk")))
        placed = placed.join(self._few(self.source_table), F.col("source").eqNullSafe(F.col("source_name")))
        return placed.select("doc_id", "text_hash", "size", "source", "source_no", "source_size", "target", "chunk", "place", (F.col("base") + F.col("before")).alias("start"))

    @property
    def blocks(self) -> DataFrame:
        """A row for each block and document that share words: the words from_word.. of the document."""
        b, w = F.col("block"), self.block_words
        rows = self.documents.filter("size > 0")
        rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / w), F.floor((F.col("start") + F.col("size") - 1) / w))))
        first = F.greatest(F.col("start"), b * w)
        last = F.least(F.col("start") + F.col("size"), (b + 1) * w)
        return rows.select("source_no", "block", "doc_id", "text_hash", "size", "chunk", "place", (first - F.col("start")).alias("from_word"), (last - first).alias("n_words"))

    @property
    def counts(self) -> DataFrame:
        """group_no, source_no, slots: how many slots of a group of GROUP shards each source gets."""
        deal = self._dealer()

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for group in batch.column(0).to_pylist():
                    counts = deal.counts(group).sum(axis=0)
                    some = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), group)), pa.array(some.astype(np.int32)), pa.array(counts[some])], ["group_no", "source_no", "slots"])

        return self.spark.range(0, deal.groups, 1, self._tasks(deal.groups)).mapInArrow(draw, "group_no long, source_no int, slots long")

    @property
    def slots(self) -> DataFrame:
        """shard, source_no, pass_no, block: the block that each slot of the mix takes.

        Two passes, both in parallel over groups of shards: the first only counts,
        the second draws the same numbers again, knows from the counts which of its
        source's slots came before it, and emits the slots.  What a source draws
        beyond ``cap`` passes is drawn anew among the sources that have room.
        """
        deal, cap, seed = self._dealer(), self.cap, self.seed
        counts = checkpoint(self.counts)
        drawn = np.zeros(len(self.sources), dtype=np.int64)
        for r in counts.groupBy("source_no").agg(F.sum("slots").alias("slots")).collect():  # a row for each source
            drawn[r["source_no"]] = r["slots"]
        again = Redraw(drawn, np.array(self.n_blocks, dtype=np.int64) * cap, np.array(self.quota), seed)
        earlier = Window.partitionBy("source_no").orderBy("group_no").rowsBetween(Window.unboundedPreceding, -1)
        first = counts.withColumn("j0", F.coalesce(F.sum("slots").over(earlier), F.lit(0)))
        tasks = self._tasks(deal.groups)
        first = first.groupBy("group_no").agg(F.collect_list(F.struct("source_no", "j0")).alias("firsts")).repartitionById(tasks, F.pmod("group_no", F.lit(tasks)).cast("int"))
        n_blocks = np.array(self.n_blocks, dtype=np.uint64)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for group, firsts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    at = np.zeros(len(n_blocks), dtype=np.int64)
                    for x in firsts:
                        at[x["source_no"]] = x["j0"]
                    for k, row in enumerate(deal.counts(group)):
                        source = np.repeat(np.arange(len(row)), row)
                        j = np.arange(len(source)) - np.repeat(np.cumsum(row) - row, row) + at[source]
                        at += row
                        source, j = again(source, j)
                        n, round_ = n_blocks[source], j.astype(np.uint64) // n_blocks[source]
                        key = (source.astype(np.uint64) * np.uint64(1 << 20) + round_) * np.uint64(2654435761) + np.uint64(seed)
                        block = permute(j.astype(np.uint64) % n, n, key).astype(np.int64)
                        shard = np.full(len(source), group * GROUP + k)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard, source.astype(np.int32), round_.astype(np.int64), block)], ["shard", "source_no", "pass_no", "block"])

        return first.mapInArrow(emit, "shard long, source_no int, pass_no long, block long")

    def _dealer(self) -> Dealer:
        return Dealer(self.n_slots, self.shard_slots, np.array(self.quota), self.seed)

    def _tasks(self, groups: int) -> int:
        return max(1, min(groups, 4 * shuffle_partitions(self.spark)))

    @property
    def mixture(self) -> DataFrame:
        """The mix itself: for each slot the documents and words that it takes."""
        # the planner sees a few shards, not their slots, and would broadcast them
        return self.slots.hint("merge").join(self.blocks, ["source_no", "block"])

    @property
    def taken(self) -> DataFrame:
        """``documents`` and the words that the mix takes of each, repeats counted."""
        name = ["source_no", "chunk", "place"]
        took = self.mixture.groupBy(*name).agg(F.sum("n_words").alias("taken"))
        return self.documents.join(took, name, "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs as the mix takes them: a row for each document and pass, with the words taken in that pass.

    A document taken whole keeps its text; of one taken in part the taken words
    stay, in their order, joined by single spaces.  A column n_chars is set to the
    new text's length.  Other columns pass through, whatever their names; rows of
    the same id and text are documents of their own, with the other columns of one
    of them.  Documents without words (null and empty texts) give no row; an empty
    table gives an empty result.
    """
    mix = Mix(docs, id_col, text_col, **options)
    ranges = mix.mixture.groupBy("source_no", "chunk", "place", "pass_no", "doc_id", "text_hash", "size").agg(
        F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("__ranges"), F.sum("n_words").alias("__words")
    )
    text = F.col(text_col)
    # plain equalities, null ids flagged: the join finds the texts where the removal of repeated rows has put them, so they are shuffled once
    name = lambda id_, hash_: [id_.isNull().alias("none"), F.coalesce(id_.cast("string"), F.lit("")).alias("id"), hash_.alias("key")]
    ranges = ranges.select(*name(F.col("doc_id"), F.col("text_hash")), F.col("size").alias("__size"), "__ranges", "__words")
    texts = docs.select(*name(F.col(id_col), F.xxhash64(text)), F.struct(*docs.columns).alias("doc")).dropDuplicates(["none", "id", "key"])
    both = texts.join(ranges.hint("merge"), ["none", "id", "key"])
    whole, own = F.col("__words") >= F.col("__size"), F.col("doc").getField(text_col)
    words = F.array_remove(F.split(F.translate(own, "\t\n\v\f\r", " " * 5), " "), "")
    # the words are bound to a variable: a column of them would be inlined by the optimiser and split anew for every range
    cut = lambda all_: F.concat_ws(" ", F.flatten(F.transform("__ranges", lambda r: F.slice(all_, (r["from_word"] + 1).cast("int"), r["n_words"].cast("int")))))
    part = F.transform(F.array(words), cut)[0]
    both = both.withColumn("new", F.when(whole, own).otherwise(part))
    changed = {text_col: F.col("new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return both.select(*[changed.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and source for every row of documents; edge cases as in ``Mix``."""
    mix = Mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix.taken.select("doc_id", "size", "source_size", "target", "taken", "source")
