import random
import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from ashlar.llm import licenses

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


LONG = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
TEXTS = [
    None, "", "the mit", "The MIT License", "the mit license the-mit-license THE mit/license", "é the mit licenseé the mit license.",
    "Apache License, Version 2.0", "apache license version 2 apache license version 2", "under CC BY-NC 4.0. cc by nc", "cc by cc by nc nc",
    "x " * 5000 + "cc by nc " * 300, LONG, "Permission is hereby gladly granted, free of charge, to any person obtaining a copy of software and associated documentation files",
    "This work is licensed under the GNU General Public License, version 3.", "licensed under the bad license", "licensed under the BSD license",
]


def test_base_places_against_brute_force(spark, edge, nothing):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", "y")] * 2 + [(None, TEXTS[4], "x", "y")], "doc_id long, text string, label string, start string")
    both = df.select("doc_id", "text").union(edge.select("doc_id", "text"))
    got = licenses.scan(both).collect()
    want = [(r.doc_id, *brute(r.text)) for r in both.collect()]
    assert Counter((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter(want)
    by_id = {r.id: r for r in licenses.scan(df).collect()}
    assert by_id[11].labels == "mit" and by_id[11].score == 1.0
    assert by_id[12].labels == "mit" and 0.9 <= by_id[12].score < 1  # a word more and a word less
    assert by_id[13].labels == "gpl-3" and by_id[14].labels == "" and by_id[15].labels == "bsd"
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} for r in got)
    assert by_id[0].score == 0 and by_id[0].labels == ""
    assert licenses.scan(nothing).collect() == []


def slow_scan(text, templates):
    """Labels and score by loops over all words and template places."""
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    labels, score = set(), 0.0
    for label, phrase, base in templates:
        t = WORDS.findall(phrase.lower())
        votes = defaultdict(set)
        for i in range(len(words) - 2):
            for j in range(len(t) - 2):
                if words[i : i + 3] == t[j : j + 3]:
                    votes[i - j] |= {j, j + 1, j + 2}
        spans, before = [], None
        for start in sorted(votes):
            if base or before is None or start - before > licenses.GAP:
                spans.append(set())
            spans[-1] |= votes[start]
            before = start
        for span in spans:
            share = len(span) / len(t)
            if share >= (1 if base else licenses.COVER):
                labels.add(label)
                score = max(score, share)
    return ",".join(sorted(labels)), score


def known():
    return [*((v, k, True) for k, v in licenses.BASE.items()), *((v, k, False) for k, v in licenses.TEMPLATES.items())]


def damaged():
    """Templates with words left out, put in and changed, between other words."""
    rng = random.Random(3)
    out = []
    for _ in range(250):
        words = []
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(known())[1].split()
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice([[], ["very"], [t[at], t[at]]])
                t = t or ["x"]
            words += rng.choices(["the", "license", "software", "of"], k=rng.randint(0, 4)) + t
        out.append(rng.choice([" ", ", ", "\n"]).join(words))
    return out


def test_labels_and_score_against_loops(spark, monkeypatch):
    texts = [*damaged(), None, "", "the mit"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.labels, r.score) for r in licenses.scan(df).collect()}
    assert got == {i: slow_scan(t, known()) for i, t in enumerate(texts)}
    assert len({x for x, _ in got.values()}) > 15 and any(0 < s < 1 for _, s in got.values())
    monkeypatch.setattr(licenses, "POSITIONS", 10)  # joined by a shuffle
    assert {r.id: (r.labels, r.score) for r in licenses.scan(df).collect()} == got
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert {r[0]: (r[6], r[7]) for r in con.execute(licenses.OP6_SQL).fetchall()} == got


def test_own_templates(spark):
    mine = [("long", "One two THREE, four five six; seven eight nine ten eleven twelve.", None), ("short", "a b", False), ("base", "alpha beta gamma", True)]
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "a b alpha beta gamma gamma"), (3, "two three four")], "doc_id long, text string")
    got = {r.id: (r.labels, r.n_base) for r in licenses.scan(df, templates=spark.createDataFrame(mine, "label string, text string, base boolean")).collect()}
    assert got == {1: ("long", 0), 2: ("base", 1), 3: ("", 0)}


def test_texts_of_one_id_and_one_xxhash64(spark):
    """Two texts of equal length, number of words and XXH64; only the first holds a phrase, under its own id and under one they share."""
    texts = ["1gbqes1d  a b c d e f g the mit license  and so on this text end", "qyk09haj  a b c d e f g the mit Lb<'(\x0c\x13\x0e and so on this text end"]
    df = spark.createDataFrame([(i, t) for i in (1, None) for t in [*texts, texts[0]]] + [(2, texts[0]), (3, texts[1])], "doc_id long, text string")
    assert df.select(F.xxhash64("text"), F.length("text")).distinct().count() == 1
    got = licenses.scan(df).collect()
    want = [(r.doc_id, *brute(r.text)) for r in df.collect()]
    assert len({w[1] for w in want}) == 1 and {w[2] for w in want} == {0, 1}
    assert Counter((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter(want)
    assert Counter((r.id, r.labels, r.score) for r in got) == Counter((r.doc_id, *slow_scan(r.text, known())) for r in df.collect())
