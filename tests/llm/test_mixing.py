import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ashlar.llm import feistel, mixing


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4096, 70_001])
def test_permutation(n):
    for key in (0, 1, 2**40 + 7):
        assert sorted(feistel.permute(np.arange(n), n, key).tolist()) == list(range(n))
    if n > 100:
        assert (feistel.permute(np.arange(n), n, 1) != feistel.permute(np.arange(n), n, 2)).mean() > 0.9
    with pytest.raises(ValueError):
        feistel.permute([n], n, 1)


def test_targets():
    assert mixing.fill_targets([100, 100, 100], [5, 2, 1], 3) == pytest.approx([187.5, 75, 37.5])
    got = mixing.fill_targets([10, 1000, 0, 500], [5, 2, 1, 5], 3)  # the first stops at 30, the rest is shared 2 : 5
    assert got == pytest.approx([30, 1480 * 2 / 7, 0, 1480 * 5 / 7])
    assert mixing.fill_targets([0, 0], [1, 1], 3) == [0, 0]
    assert mixing.fill_targets([], [], 3) == []


def expected(rows):
    size = defaultdict(int)
    for r in rows:
        size[r.source] += len((r.text or "").encode().split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weights = [(5, 2, 1)[i % 3] for i in range(len(names))]
    targets = mixing.fill_targets([size[s] for s in names], weights, 3)
    return dict(zip(names, [(size[s], t) for s, t in zip(names, targets)]))


def test_mix(edge):
    rows = edge.collect()
    want = expected(rows)
    got = mixing.Mix(edge, block_words=8, shard_slots=512).taken.collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == want[r.source][0] and math.isclose(r.target, want[r.source][1])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, (_, target) in want.items():
        assert abs(taken[s] - target) <= max(30, 0.02 * target), (s, taken[s], target)
    again = mixing.Mix(edge.repartition(3), block_words=8, shard_slots=512).taken.collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, got), key=str) == sorted(map(key, again), key=str)


def test_blocks_cover_every_word_once(edge):
    mix = mixing.Mix(edge, block_words=16)
    words = defaultdict(int)
    by_block = defaultdict(int)
    for b in mix.blocks.collect():
        words[b.source_no] += b.n_words
        by_block[b.source_no, b.block] += b.n_words
    for i, (_, size) in enumerate(mix.sources):
        assert words[i] == size
        full = [n for (s, b), n in by_block.items() if s == i and b < mix.n_blocks[i] - 1]
        assert set(full) <= {16}
    seen = defaultdict(int)
    for s in mix.slots.collect():
        seen[s.source_no, s.pass_no, s.block] += 1
    assert set(seen.values()) == {1} and all(p < 3 for _, p, _ in seen)


def test_mixed_documents(edge, nothing):
    out = mixing.mixed_documents(edge, block_words=8)
    assert out.columns == edge.columns
    rows = out.collect()
    total = sum(r.taken for r in mixing.Mix(edge, block_words=8).taken.collect())
    assert sum(len(r.text.encode().split()) for r in rows) == total
    assert all(r.n_chars == len(r.text) for r in rows)
    originals = {r.text for r in edge.collect()}
    assert any(r.text in originals for r in rows)
    assert mixing.mixed_documents(nothing).collect() == []
    assert mixing.Mix(nothing).taken.collect() == []


def test_ids_of_any_type_and_texts_shuffled_once(spark):
    rows = [(None, "a b c d"), ("", "a b c d"), ("x", "e f g h"), ("x", "e f g h")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id string, text string, source string")
    out = mixing.mixed_documents(docs, block_words=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[none[^\n]*\n\s*:- SortAggregate", plan), plan  # no exchange between the two
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(rows)  # one source gives each block once


def test_a_text_is_split_once_not_for_every_range(spark):
    docs = spark.createDataFrame([(1, "a b c " * 3000, "web")], "doc_id long, text string, source string")
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert not re.search(r"slice\((?:(?!lambda).)*split\(", plan)  # not inside what is done for each range


def test_sources_without_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None), (3, "  ", "a")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.target, r.taken) for r in mixing.Mix(df).taken.collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0), (3, 0, 0.0, 0)}


def test_surplus_is_drawn_anew():
    drawn, room, quota = np.array([12, 5, 0, 40]), np.array([10, 30, 3, 33]), np.array([3.0, 1.0, 1.0, 2.0])
    again = mixing.Redraw(drawn, room, quota, 1)
    source = np.repeat(np.arange(4), drawn)
    j = np.concatenate([np.arange(n) for n in drawn])
    s, k = again(source, j)
    assert len(s) == drawn.sum() and len(set(zip(s.tolist(), k.tolist()))) == len(s)
    assert (np.bincount(s, minlength=4) <= room).all() and (k < room[s]).all()
    full = mixing.Redraw(np.array([5, 5]), np.array([3, 5]), np.array([1.0, 1.0]), 1)(np.repeat([0, 1], 5), np.tile(np.arange(5), 2))
    assert len(full[0]) == 8  # nobody has room


def test_taken_by_a_slow_replay(spark, edge):
    """Streams, blocks, draws and passes once more, one word at a time."""
    rows = edge.collect()
    mix = mixing.Mix(edge, block_words=8, shard_slots=64)
    streams = defaultdict(list)
    for d in sorted((r for r in mix.documents.collect()), key=lambda r: (r.source_no, r.start, -r.size)):
        assert d.size == 0 or d.start == len(streams[d.source_no])
        streams[d.source_no] += [(d.chunk, d.place)] * d.size
    blocks = {s: [w[i : i + 8] for i in range(0, len(w), 8)] for s, w in streams.items()}
    deal = mix._dealer()
    taken, given = defaultdict(int), defaultdict(int)
    picks = [(s, n) for g in range(deal.groups) for row in deal.counts(g) for s, n in enumerate(row)]
    total = defaultdict(int)
    for s, n in picks:
        total[s] += int(n)
    again = mixing.Redraw(np.array([total[s] for s in range(len(mix.sources))]), np.array(mix.n_blocks) * 3, np.array(mix.quota), mix.seed)
    for s, n in picks:
        for _ in range(n):
            (to,), (j,) = again(np.array([s]), np.array([given[s]]))
            given[s] += 1
            size = mix.n_blocks[to]
            key = np.uint64((int(to) * (1 << 20) + int(j) // size) * 2654435761 % 2**64) + np.uint64(mix.seed)
            for word in blocks[to][int(feistel.permute([j % size], size, key)[0])]:
                taken[(int(to), *word)] += 1
    got = mix.taken.collect()
    assert len(got) == len(rows) and deal.shards > mixing.GROUP
    assert {(r.source_no, r.chunk, r.place): r.taken for r in got if r.taken} == dict(taken)
    assert mix.slots.rdd.getNumPartitions() > 1
