import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ashlar.llm import quality

from .conftest import prose


def test_fit_of_main_effects_and_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.Gam(pairs=2).fit(x, y)
    assert (0, 1) in model.pair_tables
    assert ((model.score(x) > 0.5) == y).mean() > 0.9  # nothing but the pair tells
    y = (x[:, 2] > 0.3).astype(float)
    assert ((quality.Gam().fit(x, y).score(x) > 0.5) == y).mean() > 0.97
    assert set(quality.Gam().fit(x[:5], np.ones(5)).score(x)) == {6 / 7}
    assert quality.Gam().fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_features_of_any_text():
    for t in (b"", b" ", b"\n\n", b"word", "é\x00|!".encode(), b"A" * 100_000):
        f = quality.features(t)
        assert len(f) == len(quality.FEATURES) and np.isfinite(f).all()


def test_held_out_accuracy(spark, nothing):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        text = prose(rng, rng.randint(10, 100))
        good = i % 3 > 0
        if not good:
            text = " ".join(w + rng.choice(["$$$", "%%%", "###"]) for w in text.split()) if i % 2 else text.upper().replace(" ", "!! ")
        rows.append((i, text, "x"))
        labels.append((i, int(good), "y"))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "text", "x"), (5, rows[5][1], "x")]
    labels += [(7, None, "y"), (None, 1, "y"), (9, 0, "y"), (9, 0, "y"), (99999, 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    model = quality.fit(docs, lab)
    got = quality.scored(docs, model).withColumn("held_out", quality.held_out()).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(held) > 50 and np.mean([(r["score"] >= 0.5) == (r.doc_id % 3 > 0) for r in held]) > 0.95
    left = quality.good_documents(docs, lab)
    assert left.columns == docs.columns and 300 < left.count() < 560
    assert quality.good_documents(nothing, lab).collect() == []
    assert quality.scored(docs, quality.fit(docs, lab.filter(F.lit(False)))).first()["score"] == 0.5


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "good text" if i % 2 else "BAD!! TEXT!!") for i in range(300)], "doc_id long, text string")
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    a = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    b = spark.createDataFrame([(i, 1 - i % 2 if i in held else i % 2) for i in range(300)], "doc_id long, quality int")
    x = np.array([quality.features(t) for t in (b"good text", b"BAD!! TEXT!!", b"other")])
    assert quality.fit(docs, a).score(x).tolist() == quality.fit(docs, b).score(x).tolist()


def test_scores_and_cuts_against_loops():
    """A score is the logistic of table entries added up one by one; a cut is the best of all cuts."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = quality.Gam(rounds=8, pair_rounds=4).fit(x, y)
    assert model.pair_tables
    for row, score in zip(x, model.score(x)):
        f = model.prior
        for edges, values, v in zip(model.edges, model.tables, row):
            f += values[sum(e <= v for e in edges)]
        for (i, j), values in model.pair_tables.items():
            f += values[sum(e <= row[i] for e in model.pair_edges[i]), sum(e <= row[j] for e in model.pair_edges[j])]
        assert abs(score - 1 / (1 + np.exp(-f))) < 1e-12
    for _ in range(50):
        g, h = rng.normal(size=9), rng.random(9)
        gains = [(g[:k].sum() ** 2 / (h[:k].sum() + 1) + g[k:].sum() ** 2 / (h[k:].sum() + 1) - g.sum() ** 2 / (h.sum() + 1), k) for k in range(1, 9) if h[:k].sum() >= 0.5 and h[k:].sum() >= 0.5]
        gain, at = quality._split(g, h, 0.5, 1.0)
        best = max(gains, default=(-1.0, 0))
        assert abs(gain - best[0]) < 1e-9 and (not gains or at == best[1])
        leaf = quality._tree(g, h, 1, 0.5, 1.0)
        if gains and best[0] > 1e-12:
            assert np.allclose(leaf[:at], g[:at].sum() / (h[:at].sum() + 1)) and np.allclose(leaf[at:], g[at:].sum() / (h[at:].sum() + 1))
