"""Quality classifier: a generalised additive model with pairwise interactions.

Counts of a whole text become ratios; each ratio is binned at quantiles. Boosting goes round the features in cycles,
fitting a shallow tree on one feature at a time and adding it to that feature's lookup table; then the strongest pairs
get small two-dimensional tables from what the single features leave. A score is the sigmoid of an intercept plus one
table entry for each feature and pair.

The model is fitted on at most ``train_rows`` labelled rows (smallest hash of doc_id first, a documented bound); every
document is scored. Labels, lang, source and doc_id play no part in a score.

Defined results: a null text counts as empty and is scored; texts of any length are counted whole; a null doc_id counts
as the empty string for the fold; without labelled rows every score is one half; of training rows that share doc_id and
label the one with the smallest ratios counts, so training gives the same model each time; repeated rows get the same
score; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside_row, settle
from .textstats import Counts, counts

TRAIN_ROWS = 20_000
THRESHOLD = 0.3
N_FEATURES = 16


def features(text: str | None) -> list[float]:
    c = counts(text)
    return ratios(c)


def ratios(c: Counts) -> list[float]:
    words, lines, chars = max(c.n_words, 1), max(c.n_lines, 1), max(c.word_chars, 1)
    return [
        float(np.log1p(c.n_words)),
        c.word_chars / words,
        c.n_symbols / words,
        c.n_dup_lines / lines,
        c.n_repeat_words / words,
        c.n_adjacent / words,
        c.n_upper / max(c.n_letters, 1),
        c.n_letters / chars,
        c.n_digits / chars,
        c.n_marks / chars,
        c.n_bangs / words,
        c.n_bars / words,
        c.n_short / words,
        c.n_ended_lines / lines,
        float(np.log(words / max(c.n_distinct, 1))),
        float(np.log(words / lines)),
    ]


class PairwiseGam:
    """Lookup tables over binned features."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, cycles: int = 60, pair_cycles: int = 30, pairs: int = 10, rate: float = 0.15, leaf: int = 30):
        self.bins, self.pair_bins, self.cycles, self.pair_cycles, self.n_pairs, self.rate, self.leaf = bins, pair_bins, cycles, pair_cycles, pairs, rate, leaf
        self.intercept, self.edges, self.pair_edges, self.tables, self.pairs, self.pair_tables = 0.0, [], [], [], [], []

    def _bin(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], 1) if len(edges) else np.empty((len(x), 0), int)

    def _tree(self, g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
        """Leaf values of a tree over the ordered bins of one feature, from sums of gradients, curvatures and rows."""
        value = np.full(len(g), g.sum() / (h.sum() + 1.0))
        if depth == 0 or len(g) < 2:
            return value
        gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1)
        gain[(nl < self.leaf) | (n.sum() - nl < self.leaf)] = -1
        k = int(np.argmax(gain))
        if gain[k] <= g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            return value
        return np.concatenate([self._tree(g[: k + 1], h[: k + 1], n[: k + 1], depth - 1), self._tree(g[k + 1 :], h[k + 1 :], n[k + 1 :], depth - 1)])

    def _sums(self, where: np.ndarray, y: np.ndarray, f: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return np.bincount(where, y - p, size), np.bincount(where, p * (1 - p), size), np.bincount(where, minlength=size)

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseGam:
        if not len(y):
            return self
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.intercept = float(np.log(mean / (1 - mean)))
        cut = lambda n: [np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1])) for c in x.T]
        self.edges, self.pair_edges = cut(self.bins), cut(self.pair_bins)
        b = self._bin(x, self.edges)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        f = np.full(len(y), self.intercept)
        for _ in range(self.cycles):
            for k, t in enumerate(self.tables):
                step = self.rate * self._tree(*self._sums(b[:, k], y, f, len(t)), depth=2)
                t += step
                f += step[b[:, k]]
        c = self._bin(x, self.pair_edges)
        ranked = []
        for i in range(x.shape[1]):
            for j in range(i):
                cells = (len(self.pair_edges[i]) + 1) * (len(self.pair_edges[j]) + 1)
                g, h, _ = self._sums(c[:, i] * (len(self.pair_edges[j]) + 1) + c[:, j], y, f, cells)
                ranked.append((float((g**2 / (h + 5)).sum() / cells**0.5), i, j))
        self.pairs = [(i, j) for _, i, j in sorted(ranked, reverse=True)[: self.n_pairs]]
        self.pair_tables = [np.zeros((len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1)) for i, j in self.pairs]
        for _ in range(self.pair_cycles):
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                g, h, n = (s.reshape(t.shape) for s in self._sums(c[:, i] * t.shape[1] + c[:, j], y, f, t.size))
                step = self.rate * self._quadrants(g, h, n)
                t += step
                f += step[c[:, i], c[:, j]]
        return self

    def _quadrants(self, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A tree of depth two over both features: the best cut of the rows, then of each half's columns."""
        best, out = -1.0, np.full(g.shape, g.sum() / (h.sum() + 1.0))
        for turn in (False, True):
            a, b, m = (g.T, h.T, n.T) if turn else (g, h, n)
            for k in range(1, len(a)):
                halves = [slice(0, k), slice(k, None)]
                if min(m[s].sum() for s in halves) < self.leaf:
                    continue
                value = np.vstack([np.tile(self._tree(a[s].sum(0), b[s].sum(0), m[s].sum(0), 1), (len(a[s]), 1)) for s in halves])
                gain = float((2 * value * a - value**2 * b).sum())
                if gain > best:
                    best, out = gain, value.T if turn else value
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.intercept)
        if self.tables:
            b, c = self._bin(x, self.edges), self._bin(x, self.pair_edges)
            for k, t in enumerate(self.tables):
                f += t[b[:, k]]
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                f += t[c[:, i], c[:, j]]
        return 1 / (1 + np.exp(-f))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _features(texts: pd.Series) -> pd.Series:
    return texts.map(features)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> PairwiseGam:
    """Fits on a bounded sample of labelled rows outside the held-out fold."""
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", F.pandas_udf(_features, "array<double>")("text").alias("x"))
    rows = rows.groupBy("doc_id", "quality").agg(F.min("x").alias("x"))  # a doc_id that many rows share counts once, so that the bound holds
    rows = rows.toPandas().sort_values(["doc_id", "quality"], kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), N_FEATURES)
    return PairwiseGam().fit(x, rows["quality"].to_numpy(float))


def _scored(model: PairwiseGam):
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts], float).reshape(len(texts), N_FEATURES)))

    return F.pandas_udf(score, "double")(F.col("text").cast("string"))


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    score = _scored(train(docs, labels, train_rows))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold; all columns as they were. Scores are written before it returns."""
    scored = settle(beside_row(docs, score=_scored(train(docs, labels, train_rows))).where(F.col("score") >= threshold), "scored")
    return scored.select("row.*")
