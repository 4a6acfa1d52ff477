"""Ranked lexical search of many queries at once, by evaluating their common subexpressions once.

A document's score for a query is a sum over the query's terms, and a term's part in it depends on the document alone.
So a block of queries is compiled first. Terms that the same queries hold form a leaf. Then shared sets are mined: of all
pairs of queries (and of sums made before), the pair with the most parts in common gives a new sum of these parts, which
replaces them in every query that holds them all, until no two share LEAST_SHARED parts. What remains is a directed
graph from leaves through shared sums to queries. In a task, a block of documents fills the leaves' accumulators from its
postings; every shared sum is then added up once and read by all queries above it.

Documents become lists of counted terms once, which are written; statistics of the whole corpus and the queries' document
frequencies are aggregated from them. Each task keeps the best documents of each query in its own rows, and these meet in
two steps, first in parts of a query. Queries come in blocks of at most BLOCK_QUERIES queries and, one query apart,
BLOCK_TERMS distinct terms, so that what is sent to the tasks has a bound however many queries there are.

Defined results: a null text has no terms, and neither have texts of other characters; such documents count nowhere and
such queries find nothing; texts of any length are read whole; of equal scores the smaller doc_id ranks first, a null one
last; rows that repeat a doc_id are documents of their own, rows that repeat an item_id queries of their own; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ascii_words import words
from .common import settle

TOP = 10
BLOCK_QUERIES, BLOCK_TERMS = 256, 100_000
LEAST_SHARED = 2
#: Documents scored at once; a task holds this many eight-byte accumulators for each leaf, sum and query of a block.
BLOCK_DOCS = 512
#: Parts of a query in which the best of the tasks first meet.
PARTS = 32
COUNTED = "doc_id bigint, n bigint, terms binary, counts binary"


def counted_terms(docs: DataFrame) -> DataFrame:
    """doc_id, n (terms with repeats), the distinct terms joined by blanks and their counts, of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(words(x.as_py())) for x in batch.column(1)]
            terms = pa.array([b" ".join(c) for c in found], pa.binary())
            counts = pa.array([np.fromiter(c.values(), np.int32, len(c)).tobytes() for c in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.total() for c in found], pa.int64()), terms, counts], ["doc_id", "n", "terms", "counts"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return plain.mapInArrow(work, COUNTED)


class Graph(NamedTuple):
    """A compiled block: rows of accumulators are leaves, then shared sums in an order in which they can be added up."""

    terms: dict[bytes, int]
    leaf: np.ndarray
    n_leaves: int
    sums: list[np.ndarray]
    queries: list[np.ndarray]

    def additions(self) -> int:
        """Additions of accumulators for one document."""
        return sum(max(len(parts) - 1, 0) for parts in [*self.sums, *self.queries])


class _Mined:
    """Parts of each row (a query or a sum), and how many every two rows share."""

    def __init__(self, rows: np.ndarray):
        self.n, self.n_parts = rows.shape
        self.held = np.zeros((2 * self.n + 8, 2 * self.n_parts + 8), np.float32)
        self.held[: self.n, : self.n_parts] = rows
        self.shared = np.zeros((len(self.held), len(self.held)), np.float32)
        self.best = np.zeros(len(self.held), np.float32)
        self._count(np.arange(self.n))

    def _count(self, changed: np.ndarray) -> None:
        n, m = self.n, self.n_parts
        both = self.held[changed, :m] @ self.held[:n, :m].T
        both[np.arange(len(changed)), changed] = 0
        self.shared[changed, :n] = both
        self.shared[:n, changed] = both.T
        self.best[:n] = self.shared[:n, :n].max(axis=1, initial=0)

    def _grow(self) -> None:
        if self.n == len(self.held):
            self.held = np.pad(self.held, ((0, self.n), (0, 0)))
            self.shared = np.pad(self.shared, ((0, self.n), (0, self.n)))
            self.best = np.pad(self.best, (0, self.n))
        if self.n_parts == self.held.shape[1]:
            self.held = np.pad(self.held, ((0, 0), (0, self.n_parts)))

    def replace(self, least: int) -> bool:
        """Makes the largest shared set a sum of its own; whether there was one of at least this many parts."""
        if not self.n or (most := self.best[: self.n].max()) < least:
            return False
        i = int(self.best[: self.n].argmax())
        j = int((self.shared[i, : self.n] == most).argmax())
        self._grow()
        parts = np.flatnonzero(self.held[i] * self.held[j])
        users = np.flatnonzero(self.held[: self.n, parts].all(axis=1))
        self.held[np.ix_(users, parts)] = 0
        self.held[users, self.n_parts] = 1
        self.held[self.n, parts] = 1
        self.n, self.n_parts = self.n + 1, self.n_parts + 1
        self._count(np.append(users, self.n - 1))
        return True


def compiled(queries: list[list[bytes]], least_shared: int = LEAST_SHARED) -> Graph:
    """The graph of queries, each a list of its distinct terms."""
    holders: dict[bytes, list[int]] = {}
    for q, terms in enumerate(queries):
        for t in terms:
            holders.setdefault(t, []).append(q)
    leaf_of: dict[tuple[int, ...], int] = {}
    leaf = np.array([leaf_of.setdefault(tuple(h), len(leaf_of)) for h in holders.values()], np.int64)
    n_leaves, n_queries = len(leaf_of), len(queries)
    rows = np.zeros((n_queries, n_leaves), np.float32)
    for users, k in leaf_of.items():
        rows[list(users), k] = 1
    mined = _Mined(rows)
    while mined.replace(least_shared):
        pass
    parts = [np.flatnonzero(mined.held[r]) for r in range(mined.n)]
    order: list[int] = []  # sums, each after those in it
    placed = set(range(n_leaves))
    for root in range(n_leaves, mined.n_parts):
        stack = [root]
        while stack:
            x = stack[-1]
            missing = [p for p in parts[x - n_leaves + n_queries].tolist() if p not in placed] if x not in placed else []
            if missing:
                stack += missing
            else:
                stack.pop()
                if x not in placed:
                    placed.add(x)
                    order.append(x)
    at = np.arange(mined.n_parts)
    at[order] = n_leaves + np.arange(len(order))
    return Graph({t: k for k, t in enumerate(holders)}, leaf, n_leaves, [at[parts[x - n_leaves + n_queries]] for x in order], [at[p] for p in parts[:n_queries]])


def document_frequencies(docs: DataFrame, terms: dict[bytes, int]) -> np.ndarray:
    """In how many rows of counted_terms each term stands."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, df = known.value.get, np.zeros(len(known.value) + 1, np.int64)
        for batch in batches:
            for held in batch.column(0):
                found = [get(t, -1) for t in held.as_py().split()]
                df[found] += 1  # terms of a row are distinct; the last place takes those that no query has
        seen = np.flatnonzero(df[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(df[seen], pa.int64())], ["term", "df"])

    got = docs.select("terms").mapInArrow(work, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[got["term"].to_numpy()] = got["df"].to_numpy()
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Best:
    """The best documents of each query so far; of equal scores those with smaller ids, null ids last."""

    def __init__(self, n_queries: int, top: int):
        self.top = top
        self.least = np.ones(n_queries, np.int64)  # what a document must reach to be looked at
        self.query = self.score = self.doc = np.empty(0, np.int64)
        self.null = np.empty(0, bool)

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """scores: a row for each query, a column for each document."""
        q, d = np.nonzero(scores >= self.least[:, None])
        if not len(q):
            return
        query, score = np.append(self.query, q), np.append(self.score, scores[q, d])
        docs, nulls = np.append(self.doc, doc[d]), np.append(self.null, null[d])
        order = np.lexsort((docs, nulls, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[place < self.top]
        full = np.flatnonzero(place == self.top - 1)
        self.least[query[full]] = score[order[full]]
        self.query, self.score, self.doc, self.null = query[place < self.top], score[kept], docs[kept], nulls[kept]


def scores_of(graph: Graph, weight: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of a block of documents, a row for each query. Postings: document, term and its count; m by document."""
    held = np.zeros((graph.n_leaves + len(graph.sums), len(m)), np.int64)
    part = weight[term] * (1_000_000_000 * count // (1000 * count + 8 * m[doc]))
    np.add.at(held, (graph.leaf[term], doc), part)
    for k, parts in enumerate(graph.sums, graph.n_leaves):
        np.add.reduce(held[parts], axis=0, out=held[k])
    return np.array([np.add.reduce(held[parts], axis=0) for parts in graph.queries]).reshape(len(graph.queries), len(m))


def best_of_tasks(docs: DataFrame, graph: Graph, weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """query, doc_id, score: the best of each task for each query."""
    sent = docs.sparkSession.sparkContext.broadcast((graph, weight))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weight = sent.value
        get = graph.terms.get
        best = Best(len(graph.queries), top)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_DOCS):
                batch = whole.slice(at, BLOCK_DOCS)
                found = [np.array([get(t, -1) for t in x.as_py().split()], np.int64) for x in batch.column(2)]
                term = np.concatenate(found)
                doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
                count = np.frombuffer(b"".join(x.as_py() for x in batch.column(3)), np.int32).astype(np.int64)
                known = term >= 0
                m = 10 + 90 * batch.column(1).to_numpy() * n_docs // n_terms
                ids = batch.column(0)
                best.add(scores_of(graph, weight, doc[known], term[known], count[known], m), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.doc, mask=best.null), pa.array(best.score)], ["query", "doc_id", "score"])

    return docs.mapInArrow(work, "query bigint, doc_id bigint, score bigint")


def blocks(items: DataFrame, most_queries: int = BLOCK_QUERIES, most_terms: int = BLOCK_TERMS) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The queries (item_id, distinct terms), a block at a time; the driver holds one partition and one block."""
    block: list[tuple[int | None, list[bytes]]] = []
    seen: set[bytes] = set()
    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    for row in plain.toLocalIterator():
        terms = list(dict.fromkeys(words(bytes(row["text"]) if row["text"] is not None else None)))
        if block and (len(block) == most_queries or len(seen.union(terms)) > most_terms):
            yield block
            block, seen = [], set()
        block.append((row["item_id"], terms))
        seen.update(terms)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, top: int = TOP, most_queries: int = BLOCK_QUERIES, most_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents (doc_id, text) of each query (item_id, text)."""
    spark = docs.sparkSession
    schema = "query bigint, item_id bigint, doc_id bigint, score bigint"
    counted = settle(counted_terms(docs), "counted-terms", compression="zstd")
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = spark.createDataFrame([], schema)
    first = 0
    for block in blocks(items, most_queries, most_terms) if n_docs else ():
        graph = compiled([terms for _, terms in block])
        weight = weights(document_frequencies(counted, graph.terms), n_docs)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], "query bigint, item_id bigint")
        part = best_of_tasks(counted, graph, weight, n_docs, n_terms, top).join(F.broadcast(names), "query")
        found = found.unionByName(part.withColumn("query", F.col("query") + first))
        first += len(block)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    apart = Window.partitionBy("query", "part").orderBy(*order)
    near = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).withColumn("place", F.row_number().over(apart)).where(F.col("place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
p AS (SELECT r, doc_id, term, len(t) AS n, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(t) > 0) AS big_n, CAST(sum(len(t)) AS BIGINT) AS big_l FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p CROSS JOIN s GROUP BY term),
i AS (SELECT DISTINCT q, item_id, term FROM (SELECT q, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark))),
x AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))) AS part FROM p JOIN w USING (term) CROSS JOIN s),
f AS (SELECT q, item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM i JOIN x USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM f WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 10
"""
