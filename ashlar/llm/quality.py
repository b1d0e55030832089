"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is binned; cyclic boosting visits the features in turn
and adds a shallow tree over one feature's bins to that feature's lookup table.
The pairs of features that explain most of what is left get a table of two
dimensions by the same rule.  A score is the logistic of a sum of table entries,
found by vectorised bin look-ups.

Fitting reads at most ``max_rows`` labelled documents (those whose ids hash
lowest), so what reaches the driver is bounded: ``max_rows`` rows of feature
values.  Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, table

FEATURES = (
    "log_bytes", "upper", "digits", "symbols", "exclaims", "bars", "stops", "spaces",
    "lines", "beyond_ascii", "word_bytes", "distinct_words", "repeated_lines", "top_word", "longest_word", "symbol_ends",
)
#: Labelled rows that the fit reads at most.
MAX_ROWS = 50_000
THRESHOLD = 0.3

_SETS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digits": b"0123456789",
    "symbols": b"#$%&*@^~<>{}[]\\_=+/",
    "stops": b".,;:?",
    "spaces": b" \t\n\v\f\r",
}
_MASKS = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _SETS.items()}


def features(text: bytes) -> list[float]:
    """The values of FEATURES for one whole text; all zero for an empty one."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = {k: int(seen[m].sum()) for k, m in _MASKS.items()}
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    letters = share["upper"] + share["lower"]
    return [
        float(np.log1p(n)),
        share["upper"] / letters if letters else 0.0,
        share["digits"] / n,
        share["symbols"] / n,
        int(seen[33]) / n,
        int(seen[124]) / n,
        share["stops"] / n,
        share["spaces"] / n,
        int(seen[10]) / n,
        int(seen[128:].sum()) / n,
        sum(map(len, words)) / len(words) if words else 0.0,
        len(counts) / len(words) ** 0.8 if words else 0.0,  # a vocabulary grows slower than its text
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        max(counts.values()) / len(words) if words else 0.0,
        float(np.log1p(max(map(len, counts)))) if words else 0.0,
        sum(k for w, k in counts.items() if w[-1:] in b"#$%&*!|") / len(words) if words else 0.0,
    ]


def _split(g: np.ndarray, h: np.ndarray, least: float, l2: float) -> tuple[float, int]:
    """(gain, bins left of it) of the best cut of a row of bins."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + l2) + gr**2 / (hr + l2) - g.sum() ** 2 / (h.sum() + l2), -1.0)
    if not len(gain):
        return -1.0, 0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float, l2: float) -> np.ndarray:
    """A value for each bin: the leaves of a shallow tree over the bins."""
    gain, at = _split(g, h, least, l2) if depth else (-1.0, 0)
    if gain <= 1e-12:
        return np.full(len(g), g.sum() / (h.sum() + l2))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1, least, l2), _tree(g[at:], h[at:], depth - 1, least, l2)])


def _tree2(g: np.ndarray, h: np.ndarray, least: float, l2: float) -> np.ndarray:
    """A table of two dimensions: one cut of the first feature, then one of the second on either side (or the other way)."""
    best, out = -1.0, np.full(g.shape, g.sum() / (h.sum() + l2))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        gain, at = _split(a.sum(1), b.sum(1), least, l2)
        if gain > best:
            best = gain
            parts = [np.tile(_tree(a[s].sum(0), b[s].sum(0), 1, least, l2), (b[s].shape[0], 1)) for s in (slice(0, at), slice(at, None)) if b[s].shape[0]]
            out = np.concatenate(parts)
            out = out.T if turned else out
    return out


class Gam:
    """Lookup tables by feature and by pair of features.  Fit on (rows, features) values and 0/1 labels."""

    def __init__(self, bins: int = 48, pair_bins: int = 8, rounds: int = 120, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15, least: float = 2.0, l2: float = 1.0) -> None:
        self.bins, self.pair_bins, self.rounds, self.n_pairs, self.pair_rounds, self.rate, self.least, self.l2 = bins, pair_bins, rounds, pairs, pair_rounds, rate, least, l2
        self.prior, self.edges, self.tables, self.pair_edges, self.pair_tables = 0.0, [], [], [], {}

    @staticmethod
    def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        n = len(y)
        self.prior = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        self.edges = [self._cuts(c, self.bins) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pair_edges = [self._cuts(c, self.pair_bins) for c in x.T]
        if n < 2 or y.min() == y.max():
            return self
        at = [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)]
        f = np.full(n, self.prior)

        def slopes():
            p = 1 / (1 + np.exp(-f))
            return y - p, p * (1 - p)

        for _ in range(self.rounds):
            for j, b in enumerate(at):
                if len(self.tables[j]) < 2:
                    continue
                g, h = slopes()
                size = len(self.tables[j])
                step = self.rate * _tree(np.bincount(b, g, size), np.bincount(b, h, size), 2, self.least, self.l2)
                self.tables[j] += step
                f += step[b]
        # the pairs whose best small table explains most of what is left
        low = [np.searchsorted(e, c, side="right") for e, c in zip(self.pair_edges, x.T)]
        g, h = slopes()
        found = []

        def grid(i, j, g, h):
            shape = (len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1)
            cell = low[i] * shape[1] + low[j]
            return cell, np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

        for i, j in combinations(range(x.shape[1]), 2):
            if len(self.pair_edges[i]) and len(self.pair_edges[j]):
                _, gg, hh = grid(i, j, g, h)
                v = _tree2(gg, hh, self.least, self.l2)
                found.append((float((2 * v * gg - v * v * hh).sum()), i, j))
        for _, i, j in sorted(found, reverse=True)[: self.n_pairs]:
            self.pair_tables[i, j] = np.zeros((len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1))
        for _ in range(self.pair_rounds):
            for (i, j), values in self.pair_tables.items():
                cell, gg, hh = grid(i, j, *slopes())
                step = self.rate * _tree2(gg, hh, self.least, self.l2)
                values += step
                f += step.ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.prior)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables)):
            f += values[np.searchsorted(edges, x[:, j], side="right")]
        if self.pair_tables:
            low = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for pair in self.pair_tables for j in pair}
            for (i, j), values in self.pair_tables.items():
                f += values[low[i], low[j]]
        return 1 / (1 + np.exp(-np.clip(f, -500, 500)))


def _matrix(column: pa.Array) -> np.ndarray:
    texts = column.cast(pa.binary() if column.type == pa.string() else pa.large_binary())
    return np.array([features(t.as_py() or b"") for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Gam:
    """Learn from the labelled documents that aren't held out.

    Labels of the same id count by their mean, at least one half is 1; null ids
    and null labels are left out.  If an id has several rows in docs, the one whose
    text hashes lowest is learned from, so no more than max_rows rows reach the
    driver.  Other columns are not read.  Without labels or without documents
    every score is one half.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).filter(F.col("__id").isNotNull() & F.col("__y").isNotNull() & ~held_out("__id"))
    known = known.groupBy("__id").agg((F.avg("__y") >= 0.5).cast("double").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    own = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text"))
    texts = own.join(F.broadcast(known), F.col("__doc") == F.col("__id")).select(F.xxhash64("__id"), F.xxhash64("__text"), "__y", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(_matrix(batch.column(3)).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], x], ["id", "h", "y", "x"])

    found = texts.mapInArrow(run, "id long, h long, y double, x array<double>")
    rows = found.groupBy("id").agg(F.min(F.struct("h", "x", "y")).alias("first")).select("first.x", "first.y").toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # the fit is the same in whatever order the rows come
    return Gam().fit(x[order], rows["y"].to_numpy(np.float64)[order])


def score_of(text: Column, model: Gam) -> Column:
    """The score of a text column; a null text is empty.  Only the text goes to Python and only the score comes back."""

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.score(_matrix(texts)), pa.float64())

    return score(text.cast("string"))


def scored(docs: DataFrame, model: Gam, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, which replaces a column of that name: 0 to 1, higher means that label 1 is likelier.

    One pass, no shuffle, a row for every row (repeated rows: equal scores).  Null
    and empty texts score alike.  An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    return docs.withColumn(score_col, score_of(F.col(text_col), model))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that score under the threshold, with the columns of docs whatever their names.

    Every row is judged by its own text: repeated rows stay or go together, null
    texts are empty ones, rows without an id are scored like any other.
    """
    model = fit(docs, labels, id_col, text_col)
    return docs.filter(score_of(F.col(text_col), model) >= threshold)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of documents, edge cases as in ``scored`` and ``fit``; a null id isn't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
