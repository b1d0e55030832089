"""Exact dedup and SimHash against brute force."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ashlar.llm import bitslice, components, exact_dedup, simhash

from .conftest import FIELDS, prose


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("share", [0.25, 0.01])  # the second makes most repeated texts hot
def test_content_groups(edge, keep, share):
    rows = exact_dedup.content_groups(edge, keep=keep, hot_share=share).collect()
    want = defaultdict(list)
    for r in edge.collect():
        want[ascii_lower(r.text)].append(r.doc_id)
    got, kept = Counter(), defaultdict(int)
    for r in rows:
        ids = [i for i in want[ascii_lower(r.text)] if i is not None]
        best = (min if keep == "min" else max)(ids) if ids else None
        assert (r.keep_id, r.group_size) == (best, len(want[ascii_lower(r.text)]))
        got[ascii_lower(r.text), r.doc_id] += 1
        kept[ascii_lower(r.text)] += r.kept
        assert not r.kept or r.doc_id == best
    assert got == Counter((t, i) for t, ids in want.items() for i in ids)
    assert set(kept.values()) == {1}


def test_only_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "A"), (None, "b")], "doc_id long, text string")
    for share in (0.25, 0.001):
        rows = exact_dedup.content_groups(df, hot_share=share).collect()
        assert sorted((r.text.lower(), r.kept) for r in rows) == [("a", False), ("a", True), ("b", True)]


def test_exact_sql_and_columns(spark, edge, nothing):
    rows = [(i, t) for i, t, *_ in (tuple(r) for r in edge.filter("doc_id IS NOT NULL").collect())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.content_groups(df, keep="max").drop("kept").select("doc_id", "keep_id", "group_size", "text_sha256").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(f"SELECT doc_id, keep_id, group_size, text_sha256 FROM ({exact_dedup.OP5_SQL})").fetchall()
    assert Counter(map(tuple, got)) == Counter(want)
    out = exact_dedup.drop_copies(edge.withColumn("keep_id", F.lit(1)))
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert exact_dedup.content_groups(nothing).collect() == []


@pytest.mark.parametrize("n,buckets,words,radius", [(400, 1, 1, 3), (3000, 500, 1, 3), (900, 3, 6, 70), (130, 1, 2, 9), (65, 1, 1, 0), (64, 1, 1, 4), (1, 1, 1, 3)])
def test_bit_sliced_comparison(n, buckets, words, radius):
    rng = np.random.default_rng(n)
    bucket = np.sort(rng.integers(0, buckets, n))
    base = rng.integers(0, 2**63, (12, words), dtype=np.uint64)
    prints = base[rng.integers(0, 12, n)].copy()
    for _ in range(max(1, radius)):
        prints ^= (np.uint64(1) << rng.integers(0, 64, (n, words)).astype(np.uint64)) * (rng.random((n, words)) < 0.6 / words).astype(np.uint64)
    got = [p for i, j in bitslice.close_pairs(bucket, prints, radius) for p in zip(i.tolist(), j.tolist())]
    distance = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    want = {(i, j) for i, j in zip(*np.nonzero((distance <= radius) & (bucket[:, None] == bucket[None]))) if i < j}
    assert len(got) == len(set(got)) and set(got) == want
    assert n < 100 or want


def test_pigeonhole_keys_miss_nothing():
    rng = random.Random(3)
    keys = [sum(((1 << n) - 1) << s for s, n in ranges) for ranges in simhash.exact_keys(64, 3)]
    assert all(bin(k).count("1") == 28 for k in keys)
    for _ in range(3000):
        flip = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not flip & k for k in keys)


def slow_print(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_groups_against_all_pairs(spark, edge):
    rng = random.Random(8)
    base = prose(rng, 300).split()
    near = []
    for i in range(150):  # a chain of near copies, each a word further
        base[rng.randrange(300)] = "w%d" % i
        near.append((1000 + i, " ".join(base)) + (None,) * 9)
    df = edge.union(spark.createDataFrame(near, FIELDS)).filter("coalesce(doc_id, 0) not in (160, 161)")
    found = simhash.groups(df, k=3).withColumn("hex", simhash.hex_print()).collect()
    prints = {int(r.hex, 16) for r in found}
    links = [(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 3]
    assert links
    root = union(links, prints)
    low = defaultdict(list)
    for r in found:
        if r.id is not None:
            low[root[int(r.hex, 16)]].append(r.id)
    want = Counter((r.doc_id, slow_print(r.text, 3)) for r in df.collect())
    assert Counter((r.id, int(r.hex, 16)) for r in found) == want
    assert all(r.component_id == min(low[root[int(r.hex, 16)]]) for r in found if r.id is not None)


def test_tiles_split_hot_buckets(spark, monkeypatch):
    rng = np.random.default_rng(2)
    prints = {int(x) for x in rng.integers(0, 2**20, 400)}
    rows = [(i, bytearray(int(p).to_bytes(8, "little"))) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "node long, print binary")
    monkeypatch.setattr(simhash, "TILE", 50)
    found = simhash.links(df, 3, simhash.exact_keys(64, 3))
    ordered = sorted(prints)
    want = union([(i, j) for i in range(len(ordered)) for j in range(i) if bin(ordered[i] ^ ordered[j]).count("1") <= 3], range(len(ordered)))
    got = union([(r.u, r.v) for r in found.collect()], range(len(ordered)))
    assert got == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, x) for x in range(201, 260)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(50)] + [(5, 5), (7, 6), (7, 6)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got | {r: r for r in got.values()} == union(edges, nodes)
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_near_copies_go_and_others_stay(spark, nothing):
    rng = random.Random(11)
    rows, copies = [], set()
    for i in range(120):
        words = prose(rng, 200).split()
        rows.append((i, " ".join(words)))
        if i % 4 == 0:
            for j in range(3):
                other = list(words)
                for _ in range(3):
                    other[rng.randrange(200)] = "new%d" % rng.randrange(1000)
                rows.append((1000 + 10 * i + j, " ".join(other)))
                copies.add(1000 + 10 * i + j)
    rows += [(5000, ""), (5001, None), (5002, " "), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [r.doc_id for r in simhash.drop_near_copies(df).collect()]
    assert sorted(x for x in left if x is not None) == sorted(i for i, _ in rows if i is not None and i not in copies) and None in left
    assert simhash.drop_near_copies(nothing).collect() == []
    assert simhash.groups(nothing).collect() == []


def jaccard(a, b, k=5):
    a, b = (set(zip(*(t.lower().split()[i:] for i in range(k)))) for t in (a, b))
    return len(a & b) / len(a | b)


def test_repeated_lines_count_once(spark):
    """A line repeated often neither makes near copies of different texts nor parts copies of one text."""
    rng = random.Random(21)
    text = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    rows, gone = [], set()
    for i in range(0, 60, 4):
        line, other, own = text(10) + " ", text(10) + " ", text(1000)
        rows += [(i, f"{text(1000)} {line * 30}"), (i + 1, f"{text(1000)} {line * 30}"), (i + 2, f"{own} {other * 2}"), (i + 3, f"{own} {other * 30}")]
        assert jaccard(rows[-4][1], rows[-3][1]) < 0.05 and jaccard(rows[-2][1], rows[-1][1]) > 0.98
        gone.add(i + 3)
    left = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {i for i, _ in rows} - gone


def test_only_verified_links_count(spark, monkeypatch):
    """Texts just under the similarity stay, in small groups and in tiled ones; links over it are closed transitively."""
    monkeypatch.setattr(simhash, "SPREAD", 10, raising=False)
    rng = random.Random(22)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(10**9)}" for _ in range(404)]
        rows.append((100 * g, " ".join(base)))
        for j in range(1, 6 if g else 40):
            words = list(base)
            for at in rng.sample(range(5, 395, 6), rng.choice((6, 8, 9, 10, 12)) if g else rng.choice((4, 9))):
                words[at] = f"n{rng.randrange(10**9)}"
            rows.append((100 * g + j, " ".join(words)))
    pairs = [(a, b, jaccard(x, y)) for a, x in rows for b, y in rows if a < b and a // 100 == b // 100]
    assert sum(0.7 < s < 0.8 for _, _, s in pairs) > 50
    root = union([(a, b) for a, b, s in pairs if s >= 0.8], [i for i, _ in rows])
    left = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == set(root.values())


def test_one_id_with_two_texts(spark):
    """The row of the copy goes, the other text of its id stays, and the two texts' groups stay apart."""
    rng = random.Random(23)
    a, b, c = (prose(rng, 200) for _ in range(3))
    rows = [(1, a), (5, a + " end"), (5, b), (7, b + " end"), (9, c)]
    left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, left)) == sorted([(1, a), (5, b), (9, c)])


def test_a_large_group_gives_spanning_links_without_its_pairs():
    """4,000 fingerprints near one another have 8 million pairs; 3,999 links join them."""
    rng = np.random.default_rng(2)
    prints = np.full((4000, 1), 0x0123456789ABCDEF, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, (4000, 1)).astype(np.uint64))
    prints = np.concatenate([prints, rng.integers(0, 2**63, (500, 1)).astype(np.uint64)])
    forest, pairs, links = bitslice.Forest(4500), 0, 0
    for i, j in bitslice.close_pairs(np.zeros(4500, dtype=int), prints, 3, forest.tree):
        pairs += len(i)
        links += len(forest.join(i, j)[0])
    assert links == 3999 and pairs < 2_000_000
    assert len(set(forest.tree[:4000].tolist())) == 1 and len(set(forest.tree.tolist())) == 501


def test_forest_against_a_plain_union_find():
    rng = np.random.default_rng(4)
    for _ in range(30):
        i, j = rng.integers(0, 50, (2, 60))
        i, j = i[i != j], j[i != j]
        good = rng.random((50, 50)) < 0.6
        forest = bitslice.Forest(50)
        a, b = forest.join(i, j, lambda x, y: good[x, y])
        up = list(range(50))
        for x, y in zip(i.tolist(), j.tolist()):
            if good[x, y]:
                old, new = max(up[x], up[y]), min(up[x], up[y])
                up = [new if u == old else u for u in up]
        assert forest.tree.tolist() == up and len(a) == 50 - len(set(up)) and good[a, b].all()


def test_a_name_that_is_too_long_raises(spark):
    import pytest

    prints = spark.createDataFrame([(1, bytearray(16))], "node long, print binary")
    with pytest.raises(ValueError):
        simhash._deal(prints, simhash.sampled_keys(128, 60, 1000))
