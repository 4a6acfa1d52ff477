"""Toxicity by a classifier chain.

Linear models predict one category after another, and each is given the probabilities of the categories before it.
While training, those probabilities come from models that did not see the row (out-of-fold), so that a later model
meets the same kind of input in training and in use. The last link is the overall label that the labels table carries.

That table names no categories, so training finds them: toxic rows are clustered by the words that they share and that
are much likelier in toxic rows than in others, by spherical k-means from a fixed start. The largest cluster is the first
category. Toxic rows without such words are in none. No list of words comes from outside, and all links see the words of
a text, of which training selects those whose log odds differ from zero significantly, and the probabilities before them.

The models are fitted on at most ``train_rows`` labelled rows (smallest hash of doc_id first, a documented bound);
every document is scored on all its words.

Defined results: null and empty texts have no words and score what the intercepts give; a text of any length is scored
on all its words; with fewer kinds of toxic rows than categories the last ones score 0 and feed no later link;
without labelled rows all scores are 0 (so they are with toxic rows alone 1); a null doc_id counts as the empty string for the fold; of training rows that
share doc_id and label, the one with the smallest set of words counts, so training gives the same model each time;
repeated rows get the same scores; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 20_000
BITS = 20
SELECTED = 3000
LEAST_Z = 4.0
FOLDS = 3
#: Ridge penalties: a category is settled by its words, the overall label carries noise.
CATEGORY_L2, OVERALL_L2 = 0.1, 1.0
THRESHOLD = 0.3
OVERALL = "toxic"
#: The categories that training looks for, how far from zero the log odds of their words lie, and how many words they have at most.
KINDS, KIND_Z, KIND_WORDS = 4, 2.5, 500
CATEGORIES = [f"kind_{k + 1}" for k in range(KINDS)]
CHAIN = [*CATEGORIES, OVERALL]

_word = re.compile(r"\w+").findall


def tokens(text: str | None) -> set[str]:
    return set(_word((text or "").lower()))


def bucket(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) & (2**BITS - 1)


class Link(NamedTuple):
    """One model: weights by word bucket, weights of the earlier links' log odds, intercept. feeds: whether it is a model
    that later links are given, and not just a base rate."""

    words: dict[int, float]
    dense: np.ndarray
    intercept: float
    feeds: bool = True


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _log_odds(ids: np.ndarray, rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word bucket: in how many rows it is found, its log odds, and these in standard errors."""
    pos = np.bincount(ids, y[rows], 2**BITS)
    both = np.bincount(ids, minlength=2**BITS)
    neg = both - pos
    odds = np.log((pos + 0.5) / (y.sum() - pos + 0.5)) - np.log((neg + 0.5) / (len(y) - y.sum() - neg + 0.5))
    return both, odds, odds / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


def _select(ids: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The word buckets, found in five rows or more, whose log odds lie at least LEAST_Z standard errors from zero."""
    both, _, z = _log_odds(ids, rows, y)
    z = np.where(both >= 5, np.abs(z), 0)
    best = np.argsort(-z, kind="stable")[:SELECTED]
    return best[z[best] >= LEAST_Z]


def kinds_of(docs: list[np.ndarray], toxic: np.ndarray, kinds: int = KINDS) -> np.ndarray:
    """The category of each row, from 0; -1 for rows that are not toxic or have no telling word."""
    out = np.full(len(docs), -1)
    if not toxic.any() or toxic.all():
        return out
    sizes = np.array([len(d) for d in docs])
    ids, rows = np.concatenate([*docs, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(docs)), sizes)
    both, _, z = _log_odds(ids, rows, toxic.astype(float))
    z = np.where(both >= 3, z, 0)
    words = np.argsort(-z, kind="stable")[:KIND_WORDS]
    words = np.sort(words[z[words] >= KIND_Z])
    if not len(words):
        return out
    x = np.array([np.isin(words, docs[r]) for r in np.flatnonzero(toxic)], float)
    telling = x.any(axis=1)
    x, at = x[telling], np.flatnonzero(toxic)[telling]
    if not len(x):
        return out
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = x.mean(axis=0, keepdims=True) / np.linalg.norm(x.mean(axis=0))
    first = int((x @ centres[0]).argmax())  # the row nearest to the middle, then always the one farthest from those before it
    chosen = [first]
    while len(chosen) < kinds and (near := (x @ x[chosen].T).max(axis=1)).min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
    centres = x[chosen]
    for _ in range(30):
        kind = (x @ centres.T).argmax(axis=1)
        moved = np.array([x[kind == k].mean(axis=0) if (kind == k).any() else centres[k] for k in range(len(chosen))])
        moved /= np.linalg.norm(moved, axis=1, keepdims=True)
        if np.allclose(moved, centres):
            break
        centres = moved
    order = np.argsort(-np.bincount(kind, minlength=len(chosen)), kind="stable")
    out[at] = np.argsort(order)[kind]
    return out


def _fit(ids: np.ndarray, rows: np.ndarray, n: int, extra: np.ndarray, y: np.ndarray, l2: float, rounds: int = 400) -> Link:
    """Ridge logistic regression over binary words and earlier logits, by accelerated gradient steps."""
    chosen = np.sort(_select(ids, rows, y)) if len(ids) else np.empty(0, np.int64)
    at = np.searchsorted(chosen, ids) if len(chosen) else np.zeros(len(ids), np.int64)
    on = chosen[np.minimum(at, len(chosen) - 1)] == ids if len(chosen) else np.zeros(len(ids), bool)
    at, rows = at[on], rows[on]
    k = len(chosen)
    scale_w = np.sqrt(np.bincount(at, minlength=k) + 1.0) if k else np.empty(0)
    scale_e = np.sqrt((extra**2).sum(axis=0) + 1.0)
    per_row = np.bincount(rows, minlength=n).max(initial=0) + extra.shape[1] + 1
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    theta = np.zeros(k + extra.shape[1] + 1)
    theta[-1] = np.log(mean / (1 - mean))
    scale = np.concatenate([scale_w, scale_e, [np.sqrt(n)]])
    seen, speed = theta.copy(), 1.0
    for _ in range(rounds):
        f = np.bincount(rows, seen[at], n) + extra @ seen[k:-1] + seen[-1]
        r = y - 1 / (1 + np.exp(-f))
        g = np.concatenate([np.bincount(at, r[rows], k), extra.T @ r, [r.sum()]])
        g[:-1] -= l2 * seen[:-1]
        new = seen + g / (0.25 * scale**2 * min(per_row, 12) + l2)
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        seen = new + (speed - 1) / faster * (new - theta)
        if (new - theta) @ g < 0:
            seen, faster = new, 1.0
        theta, speed = new, faster
    return Link(dict(zip(chosen.tolist(), theta[:k].tolist(), strict=True)), theta[k:-1], float(theta[-1]))


def _apply(link: Link, ids: np.ndarray, rows: np.ndarray, n: int, extra: np.ndarray) -> np.ndarray:
    keys = np.array(sorted(link.words), np.int64)
    f = np.full(n, link.intercept) + (extra @ link.dense if len(link.dense) else 0)
    if len(keys) and len(ids):
        values = np.array([link.words[k] for k in keys.tolist()])
        at = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
        f += np.bincount(rows, np.where(keys[at] == ids, values[at], 0.0), n)
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def fit_chain(docs: list[np.ndarray], labels: dict[str, np.ndarray]) -> list[Link]:
    """The links in chain order; docs are the word buckets of each training row."""
    n = len(docs)
    if not n:
        return [Link({}, np.zeros(0), -40.0, False) for _ in CHAIN]
    sizes = np.array([len(d) for d in docs])
    ids = np.concatenate([*docs, np.empty(0, np.int64)]).astype(np.int64)
    rows = np.repeat(np.arange(n), sizes)
    fold = np.arange(n) % FOLDS
    extra = np.empty((n, 0))
    chain: list[Link] = []
    for name in CHAIN:
        y = labels[name].astype(float)
        if y.min() == y.max():  # training shows one kind of row alone
            chain.append(Link({}, np.zeros(extra.shape[1]), float(_logit(np.array([y.mean()]))[0]), False))
            continue
        l2 = OVERALL_L2 if name == OVERALL else CATEGORY_L2
        chain.append(_fit(ids, rows, n, extra, y, l2))
        if name == OVERALL:
            continue
        out_of_fold = np.empty(n)
        for k in range(FOLDS):
            learn, hold = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            to = np.full(n, -1)
            to[learn] = np.arange(len(learn))
            on = to[rows] >= 0
            link = _fit(ids[on], to[rows[on]], len(learn), extra[learn], y[learn], l2)
            out_of_fold[hold] = _apply(link, ids, rows, n, extra)[hold]
        extra = np.column_stack([extra, _logit(out_of_fold)])
    return chain


class Scorer:
    """The chain at work on texts."""

    def __init__(self, chain: list[Link]):
        self.chain = chain
        known = sorted({k for link in chain for k in link.words})
        self.row = {k: i for i, k in enumerate(known)}
        self.table = np.array([[link.words.get(k, 0.0) for link in chain] for k in known]).reshape(len(known), len(chain))
        self.of: dict[str, int] = {}

    def _row(self, word: str) -> int:
        r = self.of.get(word)
        if r is None:
            if len(self.of) > 300_000:
                self.of.clear()
            r = self.of[word] = self.row.get(bucket(word), -1)
        return r

    def __call__(self, text: str | None) -> list[float]:
        words = tokens(text)
        rows = {r for w in words if (r := self._row(w)) >= 0}
        linear = self.table[sorted(rows)].sum(axis=0) if rows else np.zeros(len(self.chain))
        earlier: list[float] = []
        out: list[float] = []
        for i, link in enumerate(self.chain):
            f = linear[i] + link.intercept + float(np.dot(earlier, link.dense))
            p = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
            out.append(float(p))
            if link.feeds:
                earlier.append(float(_logit(np.array(p))))
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> list[Link]:
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(train_rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([sorted({bucket(w) for w in tokens(x.as_py())}) for x in batch.column(2)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], ["doc_id", "toxic", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text").mapInArrow(work, "doc_id bigint, toxic int, ids array<int>")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("ids").alias("ids"))  # a doc_id that many rows share counts once, so that the bound holds
    got = rows.toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    toxic, ids = (got[c].combine_chunks() for c in ("toxic", "ids"))
    toxic = toxic.to_numpy(zero_copy_only=False) == 1
    ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
    found = np.split(ids.flatten().to_numpy(zero_copy_only=False), ends[:-1]) if len(toxic) else []
    kind = kinds_of(found, toxic)
    return fit_chain(found, {c: kind == k for k, c in enumerate(CATEGORIES)} | {OVERALL: toxic})


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, a probability for each category, score and predicted (1: toxic) of every row."""
    chain = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_rows))
    names = [f"p_{c}" for c in CATEGORIES] + ["score"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(chain.value)
        for batch in batches:
            found = [scorer(x.as_py()) for x in batch.column(2)]
            cols = [pa.array([f[i] for f in found], pa.float64()) for i in range(len(CHAIN))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "held_out", *names])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = plain.mapInArrow(work, "doc_id bigint, held_out boolean, " + ", ".join(f"{n} double" for n in names))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
