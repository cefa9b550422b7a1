"""Quality classifier: a generalised additive model with pairwise interactions.

Every text gets a few numeric features (:data:`FEATURES`), each cut into bins at
training quantiles.  Boosting goes round the features: in turn each feature gets
a shallow tree on its bins, fitted to the current residuals and added, shrunk,
to that feature's lookup table.  The strongest pairs of features then get tables
of their own in the same way.  A score is the logistic of an intercept plus one
addition a table, by vectorised bin lookups.

Edge cases: null text counts as empty, and an empty text gets the score of its
(all zero) features.  Without labelled rows every score is 0.5; with one label
only, that label's smoothed rate.  Several labels of one key count as the larger; of
several texts of one key the one whose features sort first is learned from.
Ties and repeated rows score alike; extra columns are carried along by
:func:`classify`, except ones named like its results.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrowmap import add_columns
from tessera.llm.kernels import mix, words

FEATURES = ("log_words", "word_bytes", "upper", "symbols", "digits", "stops", "beyond_ascii", "distinct", "repeats", "symbol_ends", "short_words", "line_words")
#: Most labelled rows the model is fitted on.
ROWS = 20_000
BINS, ROUNDS, RATE, LEAVES, PAIRS, LEAST = 32, 120, 0.15, 4, 6, 5
#: A document is predicted to be of quality 1 from this score on.
THRESHOLD = 0.7

_B = np.arange(256)
_UPPER, _LOWER, _DIGIT = (_B >= 65) & (_B <= 90), (_B >= 97) & (_B <= 122), (_B >= 48) & (_B <= 57)
_STOP = np.isin(_B, [ord(c) for c in ".,"])
_SYMBOL = (_B > 32) & (_B < 127) & ~_UPPER & ~_LOWER & ~_DIGIT & ~np.isin(_B, [ord(c) for c in ".,'\"-"])


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text, over its whole length."""
    w = words(column, lower=False)
    n = len(w.offsets) - 1
    data, bounds = w.data, w.bounds

    def per_text(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return np.diff(sums[w.offsets]).astype(float)

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, mask, n)

    count = np.diff(bounds).astype(float)
    size = np.diff(w.offsets).astype(float)
    upper, lower = per_text(_UPPER), per_text(_LOWER)
    high = per_text(_B >= 128)
    shown = np.maximum(1.0, per_text(_B > 32))
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    _, first = np.unique(w.hash ^ mix(w.doc.astype(np.uint64) + np.uint64(1)), return_index=True)
    some = np.maximum(1.0, count)
    length = w.end - w.start
    out = [
        np.log1p(count),
        np.bincount(w.doc, length, n) / some,
        upper / np.maximum(1.0, upper + lower),
        per_text(_SYMBOL) / shown,
        per_text(_DIGIT) / shown,
        per_text(_STOP) / shown,
        high / shown,
        np.bincount(w.doc[first], minlength=n) / np.maximum(1.0, count) ** 0.9,
        per_word(same) / some,
        per_word(_SYMBOL[data[w.end - 1]] if len(w.end) else np.empty(0)) / some,
        per_word(length <= 3) / some,
        count / (1.0 + per_text(_B == 10)) * (size > 0),
    ]
    return np.stack(out, axis=1) if n else np.zeros((0, len(FEATURES)))


@dataclass
class AdditiveModel:
    """``edges[i]``: bin limits of feature i; ``tables[i]``: its additions; ``pairs``: (i, j, additions by both bins)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for i, t in enumerate(self.tables):
            total += t[b[:, i]]
        for i, j, t in self.pairs:
            total += t[b[:, i], b[:, j]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _tree(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Newton steps of a shallow tree over ordered bins: the best cuts, greedily, up to ``leaves`` leaves."""
    g, h, n = (np.concatenate([[0], np.cumsum(a)]) for a in (grad, hess, rows))
    cuts = [0, len(grad)]

    def worth(a: int, b: int) -> float:
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)

    while len(cuts) <= leaves:
        best, at = 1e-9, None
        for a, b in zip(cuts, cuts[1:]):
            for c in range(a + 1, b):
                if min(n[c] - n[a], n[b] - n[c]) >= LEAST and (gain := worth(a, c) + worth(c, b) - worth(a, b)) > best:
                    best, at = gain, c
        if at is None:
            break
        cuts = sorted([*cuts, at])
    step = np.zeros(len(grad))
    for a, b in zip(cuts, cuts[1:]):
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return step


def _cross(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut on each of two features: its gain and its steps on the grid."""
    G, H, N = (a.cumsum(0).cumsum(1) for a in (g, h, n))
    total = [G[-1, -1], H[-1, -1], N[-1, -1]]
    quads = []
    for A, t in zip((G, H, N), total):
        a, left, top = A[:-1, :-1], A[:-1, -1:], A[-1:, :-1]
        quads.append((a, left - a, top - a, t - left - top + a))
    gain = sum(a * a / (b + 1.0) for a, b in zip(quads[0], quads[1])) - total[0] ** 2 / (total[1] + 1.0)
    # What the two cuts gain apart is for the single tables.
    for axis in (0, 1):
        a, b = G.take(-1, axis=1 - axis)[:-1], H.take(-1, axis=1 - axis)[:-1]
        alone = a**2 / (b + 1.0) + (total[0] - a) ** 2 / (total[1] - b + 1.0) - total[0] ** 2 / (total[1] + 1.0)
        gain = gain - (alone[:, None] if axis == 0 else alone[None, :])
    gain = np.where(np.minimum.reduce([q >= LEAST for q in quads[2]]), gain, -np.inf)
    if gain.size == 0 or not np.isfinite(gain.max()) or gain.max() <= 0:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    step = np.zeros_like(g)
    for k, (rows, cols) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        step[rows, cols] = quads[0][k][i, j] / (quads[1][k][i, j] + 1.0)
    return float(gain[i, j]), step


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of single tables, then of the strongest pairs."""
    k = len(FEATURES)
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    intercept = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for i in range(k)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = AdditiveModel(intercept, edges, tables, [])
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    total = np.full(len(x), intercept)
    rows = [np.bincount(b[:, i], minlength=len(t)) for i, t in enumerate(tables)]

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i, t in enumerate(tables):
            g, h = residuals()
            step = RATE * _tree(np.bincount(b[:, i], g, len(t)), np.bincount(b[:, i], h, len(t)), rows[i])
            t += step
            total += step[b[:, i]]

    def grid(i: int, j: int, v: np.ndarray | None = None) -> np.ndarray:
        m = len(tables[j])
        return np.bincount(b[:, i] * m + b[:, j], v, len(tables[i]) * m).reshape(-1, m)

    g, h = residuals()
    ranked = sorted(((_cross(grid(i, j, g), grid(i, j, h), grid(i, j))[0], i, j) for i, j in combinations(range(k), 2)), key=lambda t: (-t[0], t[1:]))
    model.pairs = [(i, j, np.zeros((len(tables[i]), len(tables[j])))) for gain, i, j in ranked[:PAIRS] if gain > 0]
    for _ in range(ROUNDS // 3):
        for i, j, t in model.pairs:
            g, h = residuals()
            step = RATE * _cross(grid(i, j, g), grid(i, j, h), grid(i, j))[1]
            t += step
            total += step[b[:, i], b[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "quality") -> AdditiveModel:
    """Fit on at most ROWS labelled rows (those of lowest key hash) whose key fulfils ``use``."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known if use is None else known.where(use)
    picked = known.groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_y")).orderBy(F.xxhash64("_key"), "_key").limit(ROWS)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(picked), "_key").select("_key", "_text", F.col("_y").cast("int").alias("_y"))
    field = [T.StructField("_x", T.ArrayType(T.DoubleType()))]

    def make():
        return lambda column: [pa.array(list(features(column)), pa.list_(pa.float64()))]

    # One row a key, however often documents repeat it: at most ROWS rows reach the driver.
    got = add_columns(rows, "_text", field, make, keep=["_key", "_y"]).groupBy("_key", "_y").agg(F.min("_x").alias("_x")).toArrow()
    order = np.argsort(got.column("_key").to_numpy(), kind="stable")
    x = np.array(got.column("_x").to_pylist(), float).reshape(-1, len(FEATURES))[order]
    return fit(x, got.column("_y").to_numpy().astype(float)[order])


def classify(docs: DataFrame, model: AdditiveModel, text: str = "text", keep: list[str] | None = None, score: str = "quality_score", pred: str = "quality_pred") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``pred``."""
    fields = [T.StructField(score, T.DoubleType()), T.StructField(pred, T.IntegerType())]

    def make():
        def run(column: pa.Array) -> list:
            s = model.score(features(column))
            return [s, (s >= THRESHOLD).astype(np.int32)]

        return run

    return add_columns(docs, text, fields, make, keep)
