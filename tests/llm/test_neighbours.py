from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from ashlar.llm import neighbours


def brute(rows, k=10):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    dim = max(sorted({len(v) for _, v in rows}), key=lambda d: sum(len(v) == d for _, v in rows)) if rows else 0
    rows = sorted((i, v) for i, v in rows if len(v) == dim)
    out = {}
    for q, x in rows:
        if q % 100 == 0:
            best = defaultdict(lambda: np.inf, {i: d for d, i in out.get(q, [])})
            for i, y in rows:
                if i != q:
                    best[i] = min(best[i], float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())))
            out[q] = sorted((s, i) for i, s in best.items())
    return {q: x[:k] for q, x in out.items()}


def test_hilbert_is_a_curve():
    for dims, bits in ((1, 4), (2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = neighbours.hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1)
        assert (steps == 1).all()  # neighbours on the curve are neighbours in space


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)]
    rows += [(500 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(120)]  # one vector, many ids
    rows += [(700, None), (701, []), (800, [0.0] * 6), (802, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (803, [float("nan")] * 6), (804, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (900, [1.0, 2.0])]
    rows += [(3, rows[3][1])] * 4 + [(100, rows[7][1])]  # repeated rows; an id with two vectors
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "vec_id long, embedding array<double>, id string, v int")
    got = defaultdict(list)
    for r in neighbours.search(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.score, r.vec_id))
    want = brute(rows)
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=1e-12)
    assert neighbours.search(df.limit(0), F.col("id") % 100 == 0).collect() == []


def test_recall_in_the_hardest_case(spark):
    """Directions without structure: at least nine of ten are found, with windows that leave most rows out."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    hits = total = 0
    found = defaultdict(set)
    for r in neighbours.search(df, F.col("id") % 100 == 0).collect():
        found[r.query_id].add(r.vec_id)
    for q in range(0, 6000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argsort(d)[:10].tolist()))
        total += 10
    assert hits / total >= 0.9


def test_rows_of_a_tight_cluster_are_told_apart():
    """Keys order rows that are near each other beyond the cells of the first index."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(2000, 64)), rng.normal(size=64) + 0.003 * rng.normal(size=(1000, 64))])
    for key in neighbours.Curves(x, 64).keys(x):
        assert len(np.unique(np.stack(key, axis=-1).reshape(len(x), -1)[2000:], axis=0)) > 500


def test_far_from_the_origin(spark):
    """Squared distances cancel there; the exact ones decide."""
    rng = np.random.default_rng(8)
    rows = [(i, (1e7 + 1e-3 * rng.normal(size=16)).tolist()) for i in range(900)]
    got = defaultdict(list)
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    want = brute(rows)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert all(s == dict((i, s) for s, i in want[q]).get(i, s) for q in want for s, i in got[q])
    block = neighbours.Block(np.arange(900), np.array([v for _, v in rows]))
    for q, ids, _ in block.nearest(np.arange(0, 900, 100), np.array([rows[q][1] for q in range(0, 900, 100)]), 10):
        assert ids.tolist() == [i for _, i in want[q]]


def test_clusters_need_short_windows(spark):
    """Where vectors have structure, the measured window is the least one."""
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(400, 32)), 10, axis=0) + 0.01 * rng.normal(size=(4000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    seen = []
    real = neighbours._reach
    neighbours._reach = lambda *a: seen.append(real(*a)) or seen[-1]
    try:
        got = neighbours.search(df, F.col("id") % 100 == 0, k=9).collect()
    finally:
        neighbours._reach = real
    assert seen == [neighbours.REACH] and np.mean([r.vec_id // 10 == r.query_id // 10 for r in got]) > 0.95


def test_recall_on_the_test_table(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    df = spark.read.parquet(path)
    rows = df.filter("embedding IS NOT NULL").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    found = defaultdict(set)
    for r in neighbours.search(df, F.col("id") % 100 == 0).collect():
        found[r.query_id].add(r.vec_id)
    true = {q: set(i.tolist()) for q, i, _ in neighbours.Block(ids, x).nearest(ids[ids % 100 == 0], x[ids % 100 == 0], 10)}
    assert len(true) == len(found) and sum(len(true[q] & found[q]) for q in true) >= 0.9 * sum(map(len, true.values()))
