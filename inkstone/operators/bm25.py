"""BM25 over chunks as joins and aggregates. Statistics always cover the whole corpus, filters only the hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.functions import tables
from inkstone.functions import text as T

K1, B = 1.2, 0.75
#: Terms of queries that are sent to the tasks at most, repeated ones of different queries counted (some 50 MB), and scores
#: that a task holds at once.
MOST_ASKED, BLOCK_SCORES = 500_000, 2_000_000


def query_terms(spark: SparkSession, query: str) -> DataFrame:
    """(term, qtf) of one query, repeated terms counted."""
    one = spark.range(1).select(F.explode(T.terms(F.lit(query))).alias("term"))
    return one.groupBy("term").agg(F.count("*").alias("qtf"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n_chunks, avgdl."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.avg(F.size("terms")).alias("avgdl"))


def postings(chunks: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(doc_key, ordinal, dl, term, tf), counted inside each chunk's row; only the wanted terms where given."""
    terms = F.col("terms")
    if wanted is not None:
        keep = F.array(*(F.lit(w) for w in wanted)) if wanted else F.array().cast("array<string>")
        terms = F.filter(terms, lambda t: F.array_contains(keep, t))
    return chunks.select("doc_key", "ordinal", F.size("terms").alias("dl"), F.inline(T.counted(terms)))


def document_frequency(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def search(chunks: DataFrame, query: str, limit: int, only: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """The best chunks of one query: doc_key, ordinal, score (six decimals), best first."""
    spark = chunks.sparkSession
    wanted = query_terms(spark, query)
    terms = [r["term"] for r in wanted.collect()]  # a query is a parameter, not data
    keep = F.array(*(F.lit(t) for t in terms)).cast("array<string>")
    hits = F.filter("terms", lambda t: F.array_contains(keep, t))
    slim = chunks.select("doc_key", "ordinal", F.size("terms").alias("dl"), hits.alias("hits"), (F.lit(True) if only is None else only).alias("shown"))
    slim = tables.settle(slim, "query-terms")  # the corpus is cut and split once, for frequencies, statistics and scores
    rows = slim.where(F.size("hits") > 0).select("doc_key", "ordinal", "dl", "shown", F.inline(T.counted(F.col("hits"))))
    stats = slim.agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avgdl"))
    scored = rows.where("shown").join(F.broadcast(document_frequency(rows)), "term").join(F.broadcast(wanted), "term").crossJoin(F.broadcast(stats))
    part = F.col("qtf") * idf(F.col("n_chunks"), F.col("df")) * weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    hits = scored.groupBy("doc_key", "ordinal").agg(F.round(F.sum(part), 6).alias("score"))
    return hits.orderBy(F.desc("score"), "ordinal", "doc_key").limit(limit)


def search_many(chunks: DataFrame, queries: DataFrame, limit: int, k1: float = K1, b: float = B, most_asked: int = MOST_ASKED) -> DataFrame:
    """The best chunks of each row (query_id, query): query_id, doc_key, ordinal, score, rank. chunks are read twice.

    Up to most_asked terms of queries go to the tasks, which score their chunks where they lie and keep the best of each
    query. Beyond that postings meet the queries' terms in one join, which adaptive execution splits where a term is in
    very many chunks. Either way a query's hits are cut to the limit in every task before they meet."""
    asked = queries.select("query_id", F.explode(T.terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    few = asked.limit(most_asked + 1).toArrow()
    if few.num_rows <= most_asked:
        hits = _best_of_tasks(chunks, few, limit, k1, b, queries.schema["query_id"].dataType.simpleString())
    else:
        rows = postings(chunks)
        weights = tables.settle(asked.join(document_frequency(rows), "term"), "query-weights")
        scored = rows.join(weights, "term").crossJoin(F.broadcast(corpus_stats(chunks)))
        part = F.col("qtf") * idf(F.col("n_chunks"), F.col("df")) * weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
        hits = scored.groupBy("query_id", "doc_key", "ordinal").agg(F.sum(part).alias("score"))
    hits = hits.withColumn("score", F.round("score", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal", "doc_key")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def _counted(lists: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of the term and count for each known term of a column of term lists."""
    at = pc.index_in(pc.list_flatten(lists), value_set=known)
    row = pc.list_parent_indices(lists).to_numpy()
    held = at.is_valid().to_numpy(zero_copy_only=False)
    pair, count = np.unique(row[held].astype(np.int64) * len(known) + at.drop_null().to_numpy(), return_counts=True)
    return pair // max(len(known), 1), pair % max(len(known), 1), count


def _best_of_tasks(chunks: DataFrame, asked: pa.Table, limit: int, k1: float, b: float, id_type: str) -> DataFrame:
    """query_id, doc_key, ordinal, score: the best chunks of each task. asked: query_id, term, qtf."""
    spark = chunks.sparkSession
    terms = sorted(set(asked["term"].to_pylist()))
    ids = list(dict.fromkeys(asked["query_id"].to_pylist()))
    known = pa.array(terms, pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            df += np.bincount(_counted(batch.column(0), known)[1], minlength=len(terms))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(terms))), pa.array(df)], ["term", "df"])

    n_chunks, n_terms = chunks.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    found = chunks.select("terms").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow().sort_by("term")
    df = found["df"].to_numpy() if found.num_rows else np.zeros(len(terms))
    place = {t: k for k, t in enumerate(terms)}
    of_term = np.array([place[t] for t in asked["term"].to_pylist()], np.int64)
    number = {q: k for k, q in enumerate(ids)}
    of_query = np.array([number[q] for q in asked["query_id"].to_pylist()], np.int64)
    order = np.argsort(of_term, kind="stable")
    value = (asked["qtf"].to_numpy() * np.log((n_chunks - df[of_term] + 0.5) / (df[of_term] + 0.5) + 1))[order]
    sent = spark.sparkContext.broadcast((known, np.searchsorted(of_term[order], np.arange(len(terms) + 1)), of_query[order], value))
    average = n_terms / max(n_chunks, 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, query, value = sent.value
        best = _Best(len(ids), limit)
        step = max(1, BLOCK_SCORES // max(len(ids), 1))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                row, term, tf = _counted(batch.column(2), known)
                dl = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy()
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / average))
                many = first[term + 1] - first[term]
                held = np.repeat(first[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                sums = np.bincount(np.repeat(row, many) * len(ids) + query[held], np.repeat(part, many) * value[held], batch.num_rows * len(ids))
                best.add(sums.reshape(batch.num_rows, len(ids)), batch.column(0).to_numpy(), batch.column(1).to_numpy())
        own = pa.array(ids).take(pa.array(best.query))
        yield pa.RecordBatch.from_arrays([own, pa.array(best.doc), pa.array(best.ordinal), pa.array(best.score)], ["query_id", "doc_key", "ordinal", "score"])

    if not ids:
        return spark.createDataFrame([], f"query_id {id_type}, doc_key bigint, ordinal bigint, score double")
    slim = chunks.select(F.col("doc_key").cast("long").alias("doc_key"), F.col("ordinal").cast("long").alias("ordinal"), "terms")
    return slim.mapInArrow(score, f"query_id {id_type}, doc_key bigint, ordinal bigint, score double")


class _Best:
    """The best chunks of each query so far, by score (six decimals), ordinal and document."""

    def __init__(self, n_queries: int, limit: int):
        self.limit, self.least = limit, np.full(n_queries, 1e-12)
        self.query = self.doc = self.ordinal = np.empty(0, np.int64)
        self.score = np.empty(0)

    def add(self, scores: np.ndarray, doc: np.ndarray, ordinal: np.ndarray) -> None:
        row, query = np.nonzero(scores >= self.least - 1e-6)
        some = scores[row, query] > 0
        row, query = row[some], query[some]
        query, score = np.append(self.query, query), np.append(self.score, scores[row, query])
        docs, ordinals = np.append(self.doc, doc[row]), np.append(self.ordinal, ordinal[row])
        order = np.lexsort((docs, ordinals, -np.round(score, 6), query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        kept = order[place < self.limit]
        full = order[place == self.limit - 1]
        self.least[query[full]] = score[full]
        self.query, self.score, self.doc, self.ordinal = query[kept], score[kept], docs[kept], ordinals[kept]


def neighbours(hits: DataFrame, chunks: DataFrame, window: int) -> DataFrame:
    """Chunks of the same document within window places of a hit, the hit itself included; one row for each chunk."""
    near = hits.select("doc_key", F.explode(F.sequence(F.col("ordinal") - window, F.col("ordinal") + window)).alias("ordinal")).where("ordinal >= 0").distinct()
    return chunks.join(near, ["doc_key", "ordinal"], "left_semi")


def file_filter(display_name: Column, digest: Column, wanted: str) -> Column:
    """A file by its name, ASCII case apart, or by the start of its digest."""
    return (T.ascii_lower(display_name) == T.ascii_lower(F.lit(wanted))) | F.startswith(digest, F.lit(wanted))


def split_file_filter(query: Column) -> Column:
    """struct(wanted, rest): the first @word taken out of a query; later ones stay."""
    parts = T.words(query)
    marked = F.filter(F.transform(parts, lambda w, i: F.when(F.startswith(w, F.lit("@")) & (F.length(w) > 1), i)), lambda i: i.isNotNull())
    at = F.get(marked, F.lit(0))
    rest = F.array_join(F.filter(parts, lambda w, i: at.isNull() | (i != at)), " ")
    return F.struct(F.substring(F.get(parts, at), F.lit(2), F.length(F.get(parts, at))).alias("wanted"), rest.alias("rest"))
