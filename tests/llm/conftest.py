import random

import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, kept string, target string, size string, print string, ids string, label string"


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(n))


def edge_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with names that operators use."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(5, 120)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i].upper() if i % 2 else texts[i], "en", "s1", 1) for i in range(8)]  # copies, A-Z in either case
    rows += [(120 + i, texts[i] + " zz", None, "s2", None) for i in range(6)]  # near copies
    rows += [(140, None, None, None, None), (141, "", "en", "s0", 0), (142, " \t\n", "en", "s0", 3), (143, "one", "en", None, 3), (144, "ONE two", "en", "\U0001f600", 3)]
    rows += [(150, texts[9], "en", "s3", 5)] * 3  # repeated rows
    rows += [(None, texts[10], "en", "s3", 5), (None, None, None, None, None)]
    rows += [(160, prose(rng, 30_000), "en", "s0", 9), (161, "x" * 300_000, "en", "s0", 9)]
    return [r + ("k", "t", "s", "p", "i", "l") for r in rows]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), FIELDS).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], FIELDS)
