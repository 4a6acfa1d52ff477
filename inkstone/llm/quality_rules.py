"""Quality rules as weak supervision.

Each rule reads the counts of a whole text and votes good (1), bad (0) or abstains (2). Spark counts how many documents
show each pattern of votes; there are at most 3 ** len(RULES) patterns whatever the corpus. Over that histogram, which
covers every document, expectation-maximisation estimates the prior and each rule's vote probabilities given a good and
a bad document. A document is kept when its posterior probability of being good is at least one half and it passes the
two base limits.

Defined results: a null or empty text has no words, fails the base limits and is not kept; texts of any length are
counted whole; a posterior of exactly one half keeps; repeated rows get the same verdict; on an empty table the prior is one half and no row comes out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside_row, settle
from .textstats import Counts, counts

GOOD, BAD, ABSTAIN = 1, 0, 2
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, votes string"


def _between(value: float, good: float, bad: float) -> int:
    """Good at one end, bad at the other, no vote between."""
    if good < bad:
        return GOOD if value <= good else BAD if value >= bad else ABSTAIN
    return GOOD if value >= good else BAD if value <= bad else ABSTAIN


def _word_length(c: Counts) -> int:
    mean = c.word_chars / c.n_words if c.n_words else 0
    return GOOD if 3.5 <= mean <= 9 else BAD if mean < 2.5 or mean > 12 else ABSTAIN


#: (name, vote). The limits are shares of words, lines or letters and so hold for any corpus size.
RULES: list[tuple[str, Callable[[Counts], int]]] = [
    ("long_enough", lambda c: _between(c.n_words, 60, 30)),
    ("word_length", _word_length),
    ("few_symbols", lambda c: _between(c.n_symbols / max(c.n_words, 1), 0.02, 0.1)),
    ("lines_differ", lambda c: _between(c.n_dup_lines / max(c.n_lines, 1), 0.1, 0.3)),
    ("phrases_differ", lambda c: _between(c.n_repeat_words / max(c.n_words, 1), 0.1, 0.3)),
    ("words_change", lambda c: _between(c.n_adjacent / max(c.n_words, 1), 0.05, 0.2)),
    ("mixed_case", lambda c: _between(c.n_upper / max(c.n_letters, 1), 0.15, 0.4)),
    ("calm", lambda c: _between(c.n_bangs / max(c.n_words, 1), 0.05, 0.2)),
    ("little_punctuation", lambda c: _between(c.n_marks / max(c.word_chars, 1), 0.08, 0.15)),
    ("letters", lambda c: _between(c.n_letters / max(c.word_chars, 1), 0.85, 0.7)),
    ("words_have_letters", lambda c: _between(c.n_bare / max(c.n_words, 1), 0.02, 0.1)),
    ("short_words", lambda c: _between(c.n_short / max(c.n_words, 1), 0.2, 0.08)),
]


def votes(c: Counts) -> str:
    return "".join(str(rule(c)) for _, rule in RULES)


def base_failed(c: Counts) -> bool:
    return c.n_words < 50 or 100 * c.n_repeat_words > 50 * c.n_words


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counts(x.as_py()) for x in batch.column(1)]
        cols = [pa.array([getattr(c, n) for c in found], pa.int64()) for n in BASE]
        cols += [pa.array([base_failed(c) for c in found], pa.bool_()), pa.array([votes(c) for c in found], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *BASE, "base_failed", "votes"])


def _voted(texts: pd.Series) -> pd.DataFrame:
    found = [counts(t) for t in texts]
    return pd.DataFrame({"base_failed": [base_failed(c) for c in found], "votes": [votes(c) for c in found]})


def fit(patterns: list[tuple[str, int]], rounds: int = 200) -> dict[str, float]:
    """Posterior probability of good for each pattern of votes, by expectation-maximisation from the majority vote."""
    if not patterns:
        return {}
    seen = np.array([[int(v) for v in p] for p, _ in patterns])
    weight = np.array([n for _, n in patterns], float)
    one_hot = seen[:, :, None] == np.arange(3)
    share = ((seen == GOOD).sum(1) + 1.0) / ((seen != ABSTAIN).sum(1) + 2.0)
    good = np.where((seen == BAD).any(1), np.minimum(share, 0.5) * 0.5, share)
    for _ in range(rounds):
        prior = (weight @ good + 1) / (weight.sum() + 2)
        log_odds = np.full(len(seen), np.log(prior) - np.log1p(-prior))
        given = []
        for p in (good, 1 - good):
            n = np.einsum("p,pro->ro", weight * p, one_hot) + 0.5
            given.append(np.log(n / n.sum(1, keepdims=True)))
        log_odds += np.einsum("pro,ro->p", one_hot, given[0] - given[1])
        new = 1 / (1 + np.exp(-np.clip(log_odds, -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return {p: float(g) for (p, _), g in zip(patterns, good, strict=True)}


def _posteriors(votes_of: DataFrame) -> DataFrame:
    """(votes, posterior) for every pattern that occurs: at most 3 ** len(RULES) of them, 531,441 or 30 MB, in practice some hundreds."""
    patterns = sorted((r["votes"], r["n"]) for r in votes_of.groupBy("votes").agg(F.count("*").alias("n")).collect())
    return votes_of.sparkSession.createDataFrame(sorted(fit(patterns).items()), "votes string, posterior double")


def _kept() -> Column:
    return ~F.col("base_failed") & (F.col("posterior") >= 0.5)


def judge(docs: DataFrame) -> DataFrame:
    """The base counts, votes, posterior and verdict of every row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = settle(plain.mapInArrow(_work, SCHEMA), "rule-votes")
    out = seen.join(F.broadcast(_posteriors(seen)), "votes")
    return out.select("doc_id", *BASE, "base_failed", _kept().alias("kept"), "posterior", "votes")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept; all columns as they were."""
    voted = F.pandas_udf(_voted, "struct<base_failed: boolean, votes: string>")
    marked = beside_row(docs, found=voted(F.col("text").cast("string"))).select("row", "found.*")
    marked = settle(marked, "marked")  # each text is read and counted once, for the histogram and the verdict
    good = _posteriors(marked.select("votes")).where("posterior >= 0.5").select("votes")
    return marked.where("not base_failed").join(F.broadcast(good), "votes", "left_semi").select("row.*")
