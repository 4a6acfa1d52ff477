"""Language identification of every word by a linear-chain conditional random field.

A word's features are its character n-grams with boundary marks (so prefixes and suffixes are told from inner parts),
the word itself and its membership in a lexicon of each language's frequent words, hashed into one weight table. The
transitions between the languages of neighbouring words are learned with the weights, from sequences that switch
between passages of different languages. Forward-backward over the whole text gives each word's marginals; their mean
is the text's language profile, and its largest entry the prediction.

The model is fitted on a bounded sample: about ``per_language`` documents of each language, of which one passage of at
most ``passage`` words each (documented parameters). Every word of every text is labelled. Forward-backward runs over
many texts at once in chunks: chunk transfer matrices first, then the chain of chunks, then inside all chunks together.

Defined results: null text, or text without a letter (numerals such as the superscript two are none), is ``und`` with
score 0; of languages with the same share the first by name is taken; without training rows everything is ``und``; of
training rows that share doc_id and language one passage counts, the smallest, and rows without doc_id are not learned
from; a null doc_id counts as the empty string for the fold; repeated rows get the same result; an empty table gives
no rows; lang, source and other columns are no inputs of a prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

PER_LANGUAGE = 1500
PASSAGE = 80
MOST_PASSAGES = 100_000
LEXICON = 200
BITS = 17
ORDERS = (1, 2, 3, 4)
CHUNK = 64
#: Words whose marginals a task holds at once, beside one whole text.
RUN_WORDS = 300_000
UNDETERMINED = "und"

_word = re.compile(r"[^\W\d_]+").findall
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters; the numerals that the expression takes for letters, such as the superscript two, part words."""
    words = _word((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


class Model(NamedTuple):
    languages: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words one after another, and where each word's begin."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    mask = np.uint64(2**BITS - 1)
    found, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        n = len(codes) - order + 1
        if n <= 0:
            break
        h = (h[:n] * _GOLD + codes[order - 1 :] + np.uint64(order)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        if order in ORDERS:
            inside = owner[:n] == owner[order - 1 :]
            found.append((h[inside] >> np.uint64(7)) & mask)
            owners.append(owner[:n][inside])
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)) & mask
    listed = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    known = np.flatnonzero(listed >= 0)
    found += [own, np.uint64(11) + listed[known].astype(np.uint64) * np.uint64(7919) & mask]
    owners += [np.arange(len(words)), known]
    all_owners = np.concatenate(owners)
    order = np.argsort(all_owners, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.searchsorted(all_owners[order], np.arange(len(words)))


def emissions(words: list[str], model: Model) -> np.ndarray:
    """(words, languages) scores of distinct words."""
    if not words:
        return np.empty((0, len(model.languages)), np.float32)
    f, start = features(words, model.lexicon)
    return np.add.reduceat(model.weights[f], start, axis=0)


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward marginals of sequences that stand one after another; no length is zero."""
    k = scores.shape[1]
    step = np.exp(transitions - transitions.max()).astype(np.float32)
    potential = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-12)
    chunks = -(-lengths // CHUNK)
    n = int(chunks.sum())
    first = np.cumsum(chunks) - chunks
    seq = np.repeat(np.arange(len(lengths)), chunks)
    nth = np.arange(n) - first[seq]
    begin = (np.cumsum(lengths) - lengths)[seq] + nth * CHUNK
    size = np.minimum(CHUNK, lengths[seq] - nth * CHUNK)
    at = begin[:, None] + np.minimum(np.arange(CHUNK), size[:, None] - 1)
    p = potential[at]
    real = np.arange(CHUNK) < size[:, None]

    def norm(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=-1, keepdims=True)

    # Transfer matrix of each chunk; a text's first word has no transition before it.
    m = np.tile(np.eye(k, dtype=np.float32), (n, 1, 1))
    for t in range(CHUNK):
        on = np.flatnonzero(real[:, t])
        part = m[on]
        moved = (part.reshape(-1, k) @ step).reshape(part.shape)
        if t == 0:
            moved[nth[on] == 0] = part[nth[on] == 0]
        moved *= p[on, t][:, None, :]
        m[on] = moved / moved.sum(axis=(1, 2), keepdims=True)
    # Along each text: what comes into a chunk from before and from behind.
    before = np.full((n, k), 1.0 / k, np.float32)
    behind = np.full((n, k), 1.0 / k, np.float32)
    order = np.argsort(nth, kind="stable")
    bounds = np.searchsorted(nth[order], np.arange(int(nth.max()) + 2))
    for s in range(1, len(bounds) - 1):
        c = order[bounds[s] : bounds[s + 1]]
        before[c] = norm(np.einsum("ci,cij->cj", before[c - 1], m[c - 1]))
    for s in range(len(bounds) - 2, 0, -1):
        c = order[bounds[s] : bounds[s + 1]]
        behind[c - 1] = norm(np.einsum("cij,cj->ci", m[c], behind[c]))
    # Inside all chunks together.
    forward = np.empty_like(p)
    a = before
    for t in range(CHUNK):
        moved = a @ step
        if t == 0:
            moved[nth == 0] = 1.0
        a = norm(moved * p[:, t])
        forward[:, t] = a
    b = behind
    out = np.empty((len(scores), k), np.float32)
    for t in range(CHUNK - 1, -1, -1):
        on = np.flatnonzero(real[:, t])
        out[at[on, t]] = norm(forward[on, t] * b[on])
        b = b.copy()
        b[on] = norm((p[on, t] * b[on]) @ step.T)
    return out


def fit(passages: list[tuple[str, list[str]]], rounds: int = 8, length: int = 60, seed: int = 7) -> Model:
    """Learns weights and transitions from (language, words) passages, joined into sequences that switch language."""
    languages = sorted({lang for lang, words in passages if words})
    k = len(languages)
    if not k:
        return Model([], {}, np.zeros((2**BITS, 0), np.float32), np.zeros((0, 0), np.float32))
    number = {lang: i for i, lang in enumerate(languages)}
    counted = {lang: Counter() for lang in languages}
    for lang, words in passages:
        counted[lang].update(words) if words else None
    lexicon: dict[str, int] = {}
    for lang in languages:
        for w, _ in counted[lang].most_common(LEXICON):
            best = max(languages, key=lambda x: (counted[x][w], x))
            lexicon.setdefault(w, number[best])
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in passages for w in words))}
    feature, start = features(list(vocabulary), lexicon)
    count = np.diff(np.append(start, len(feature)))
    rng = np.random.default_rng(seed)
    weights = np.zeros((2**BITS, k))
    transitions = np.zeros((k, k))
    grown_w, grown_t = np.full(weights.shape, 1e-6), np.full((k, k), 1e-6)
    own = [(np.array([vocabulary[w] for w in words]), number[lang]) for lang, words in passages if words]
    for _ in range(rounds):
        order = rng.permutation(len(own))
        tokens, truth = [], []
        for i in order:
            words, lang = own[i]
            cut = int(rng.integers(1, len(words) + 1))
            tokens.append(words[:cut])
            truth.append(np.full(cut, lang))
            if cut < len(words) and rng.random() < 0.5:
                tokens.append(words[cut:])
                truth.append(np.full(len(words) - cut, lang))
        x, y = np.concatenate(tokens), np.concatenate(truth)
        usable = len(x) // length * length
        x, y = (x[:usable], y[:usable]) if usable else (x, y)
        rows = max(1, usable // length)
        x, y = x.reshape(rows, -1), y.reshape(rows, -1)
        for at in range(0, rows, 100):
            bx, by = x[at : at + 100], y[at : at + 100]
            seen, where = np.unique(bx, return_inverse=True)
            picks = np.concatenate([feature[start[w] : start[w] + count[w]] for w in seen])
            begins = np.cumsum(count[seen]) - count[seen]
            e = np.add.reduceat(weights[picks], begins, axis=0)[where.reshape(bx.shape)]
            marginal, pairs = _expected(e, transitions)
            g = np.eye(k)[by] - marginal
            by_word = np.stack([np.bincount(where.ravel(), g[..., c].ravel(), len(seen)) for c in range(k)], 1)
            touched, back = np.unique(picks, return_inverse=True)
            spread = np.repeat(by_word, count[seen], axis=0)
            gw = np.stack([np.bincount(back, spread[:, c], len(touched)) for c in range(k)], 1) - 1e-3 * weights[touched]
            grown_w[touched] += gw**2
            weights[touched] += 0.2 * gw / np.sqrt(grown_w[touched])
            observed = np.zeros((k, k))
            np.add.at(observed, (by[:, :-1].ravel(), by[:, 1:].ravel()), 1)
            gt = observed - pairs - 1e-2 * transitions
            grown_t += gt**2
            transitions += 0.2 * gt / np.sqrt(grown_t)
    return Model(languages, lexicon, weights.astype(np.float32), transitions.astype(np.float32))


def _expected(e: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and summed pair expectations of equally long sequences (rows, length, languages)."""
    step, p = np.exp(transitions), np.exp(e - e.max(axis=2, keepdims=True))
    norm = lambda v: v / v.sum(axis=-1, keepdims=True)
    n = p.shape[1]
    a, b = np.empty_like(p), np.empty_like(p)
    a[:, 0] = norm(p[:, 0])
    for t in range(1, n):
        a[:, t] = norm((a[:, t - 1] @ step) * p[:, t])
    b[:, n - 1] = 1.0
    for t in range(n - 2, -1, -1):
        b[:, t] = norm((p[:, t + 1] * b[:, t + 1]) @ step.T)
    pairs = np.zeros_like(step)
    for t in range(1, n):
        joint = a[:, t - 1, :, None] * step * (p[:, t] * b[:, t])[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return norm(a * b), pairs


class Labeller:
    """A model at work in a task; remembers the scores of words it has met, within a bound."""

    def __init__(self, model: Model, remembered: int = 250_000):
        self.model, self.remembered = model, remembered
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.empty((0, len(self.model.languages)), np.float32)

    def word_marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """(words, languages) for each of some texts, none of them empty."""
        if len(self.row) > self.remembered:
            self._clear()
        new = [w for w in dict.fromkeys(w for words in texts for w in words) if w not in self.row]
        if new:
            self.row |= {w: len(self.table) + i for i, w in enumerate(new)}
            self.table = np.concatenate([self.table, emissions(new, self.model)])
        lengths = np.array([len(words) for words in texts])
        ids = np.fromiter((self.row[w] for words in texts for w in words), np.int64, int(lengths.sum()))
        return np.split(marginals(self.table[ids], lengths, self.model.transitions), np.cumsum(lengths)[:-1])

    def predict(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        """Language and score of each text, given by its words."""
        out = [(UNDETERMINED, 0.0)] * len(texts)
        full = [i for i, words in enumerate(texts) if words]
        if full and self.model.languages:
            for i, m in zip(full, self.word_marginals([texts[i] for i in full]), strict=True):
                share = m.mean(axis=0, dtype=np.float64)
                best = int(np.argmax(share))
                out[i] = (self.model.languages[best], float(min(1.0, max(0.0, share[best]))))
        return out


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, passage: int = PASSAGE, most: int = MOST_PASSAGES) -> Model:
    """Fits on about per_language documents of each language outside the held-out fold, most altogether."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 1))
    own = own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    share = settle(own.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("share")), "language-shares")
    chosen = own.select("doc_id", "lang").join(share, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("share") * 1_000_003)
    chosen = chosen.select("doc_id", "lang").distinct().orderBy(F.xxhash64("doc_id", "lang"), "doc_id", "lang").limit(most)

    def passages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, lang, text in zip(frame["doc_id"], frame["lang"], frame["text"], strict=True):
                words = words_of(text)
                at = xxhash.xxh3_64_intdigest(str(i)) % max(1, len(words) - passage + 1)
                rows.append((i, lang, "\n".join(words[at : at + passage])))
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "words"])

    sample = own.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "text")  # most rows at most are broadcast
    drawn_passages = sample.mapInPandas(passages, "doc_id bigint, lang string, words string").groupBy("doc_id", "lang").agg(F.min("words").alias("words"))
    got = drawn_passages.toPandas()
    got = got.sort_values(["doc_id", "lang", "words"], kind="stable")
    return fit([(lang, words.split("\n") if words else []) for lang, words in zip(got["lang"], got["words"], strict=True)])


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, passage: int = PASSAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    model = train(docs, per_language, passage)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            found: list[tuple[str, float]] = []
            run: list[list[str]] = []
            size = 0
            for x in batch.column(2):
                run.append(words_of(x.as_py()))
                size += len(run[-1])
                if size > RUN_WORDS:
                    found += labeller.predict(run)
                    run, size = [], 0
            found += labeller.predict(run)
            cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "held_out", "lang_pred", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(work, "doc_id bigint, held_out boolean, lang_pred string, score double")
