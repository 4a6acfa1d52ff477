"""Queries over chunks: terms, BM25, filters, neighbours, packing, batching and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import tables
from inkstone.functions import text as T
from inkstone.operators import bm25, chunking, context
from inkstone.streaming import ingest

from . import sql as S
from .documents import documents

QUERY = "licensed under the apache license"
REPEATED = "the license the license version"
BUDGET, BATCH, SELECT_BUDGET, SYSTEM_TOKENS = 6144, 1500, 3000, 400


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_plain_text(chunking.as_files(documents(spark, sf_dir)))


def settled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks with labels and costs as a written table, for queries that read them more than once."""
    return tables.settle(costed(chunks(spark, sf_dir)), "chunks")


def costed(rows: DataFrame) -> DataFrame:
    label = chunking.citation_label(F.col("chunk_id"), F.col("display_name"))
    return rows.withColumn("label", label).withColumn("cost", chunking.prompt_cost(F.col("token_count"), label))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return rows.select("doc_key", "ordinal", "chunk_id", "token_count", T.digest(F.col("text")).alias("text_digest"), F.size("terms").cast("long").alias("n_terms"))


def chunk_count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_tokens"))


def chunk_overlap_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each window shares with the next one of its document."""
    rows = tables.settle(chunks(spark, sf_dir).select("doc_key", "ordinal", T.words(F.col("text")).alias("w")), "chunk-words")
    after = rows.select("doc_key", (F.col("ordinal") - 1).alias("ordinal"), F.slice("w", 1, 48).alias("head"))
    tail = F.slice("w", F.greatest(F.lit(1), F.size("w") - 47), 48)
    return rows.join(after, ["doc_key", "ordinal"]).select("doc_key", "ordinal", F.when(tail == F.col("head"), F.size("head")).otherwise(0).cast("long").alias("shared_words"))


def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costed(chunks(spark, sf_dir)).select("doc_key", "ordinal", "label", "cost")


def terms_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).select("doc_key", "ordinal", F.posexplode("terms").alias("position", "term"))
    return rows.groupBy("doc_key", "ordinal").agg(F.count("*").alias("n_terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.postings(chunks(spark, sf_dir)).select("doc_key", "ordinal", "term", "tf")


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.document_frequency(bm25.postings(chunks(spark, sf_dir)))


def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies over an index to which documents were added in two batches."""
    index = ingest.TermIndex(spark, tables.work_dir(spark, "index"))
    for turn in range(2):
        index.add(chunks(spark, sf_dir).where(F.col("doc_key") % 2 == turn), turn)
    return index.document_frequency()


def streaming_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over an index that a stream of documents filled in three batches, of which the second came once more."""
    written = tables.settle(documents(spark, sf_dir).repartition(6, "doc_id"), "arriving-documents")
    index = ingest.TermIndex(spark, tables.work_dir(spark, "index"))
    rows = ingest.chunk_stream(spark, written.inputFiles()[0].rpartition("/")[0], written.schema, 2)
    ingest.index_stream(rows, index, tables.work_dir(spark, "index-log")).awaitTermination()
    index.add(chunks(spark, sf_dir), 1)
    return index.search(QUERY, 10)


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.corpus_stats(chunks(spark, sf_dir)).select("n_chunks", F.round("avgdl", 6).alias("avgdl"))


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(chunks(spark, sf_dir), QUERY, 10)


def bm25_repeated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(chunks(spark, sf_dir), REPEATED, 10)


def bm25_file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(chunks(spark, sf_dir), QUERY, 10, bm25.file_filter(F.col("display_name"), F.col("digest"), "DOC-11.TXT"))


def bm25_digest_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(chunks(spark, sf_dir), QUERY, 10, bm25.file_filter(F.col("display_name"), F.col("digest"), "a"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def bm25_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search_many(settled_chunks(spark, sf_dir), asked(spark, sf_dir), 20)


def query_file_filter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First messages of the turns with an @name put among their words."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.concat(F.lit("@ @Doc-"), F.col("turn"), F.lit(".txt "), F.coalesce("text", F.lit("")), F.lit(" @later")).alias("query"))
    rows = rows.withColumn("f", bm25.split_file_filter(F.col("query")))
    return rows.select("conv_id", "turn", F.col("f.wanted").alias("file_filter"), F.col("f.rest").alias("query"))


def adjacent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled_chunks(spark, sf_dir)
    return bm25.neighbours(bm25.search(rows, QUERY, 10), rows, 1).select("doc_key", "ordinal", "chunk_id")


def pack_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each document that fit a prompt."""
    rows = costed(chunks(spark, sf_dir)).select("doc_key", "ordinal", "cost")
    return context.pack_prefix(rows, "doc_key", ["ordinal"], BUDGET)


def pack_prompt_first_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = costed(chunks(spark, sf_dir)).select("doc_key", "ordinal", "cost")
    return context.pack_prefix(rows, "doc_key", ["ordinal"], 100, keep_first=True)


def map_reduce_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.batches(costed(chunks(spark, sf_dir)).select("doc_key", "ordinal", "cost"), "doc_key", BATCH)


def select_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled_chunks(spark, sf_dir)
    hits = bm25.search_many(rows, asked(spark, sf_dir), 20)
    taken = context.select_retrieval(hits, rows, SELECT_BUDGET)
    return context.reading_order(taken, rows.select("doc_key", "ordinal", "digest"))


def assemble_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for every document: its own chunks and the first message of the conversation of its number."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn = 0").select(F.col("conv_id").alias("request_id"), F.coalesce("text", F.lit("")).alias("query"))
    own = costed(chunks(spark, sf_dir)).select(F.col("doc_key").alias("request_id"), F.col("ordinal").alias("position"), "chunk_id", "label", "text", "cost")
    made = context.assemble(talk, own, SYSTEM_TOKENS, (2048, 512))
    return made.select("request_id", T.digest(F.col("user_prompt")).alias("prompt_digest"), F.size("included").cast("long").alias("n_included"), "estimated_tokens")


def sanitize_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with both marks put before and after them."""
    body = F.concat(F.lit(context.DOC_END), F.coalesce("text", F.lit("")), F.lit(context.DOC_START))
    return documents(spark, sf_dir).select("doc_id", T.digest(context.sanitize(body)).alias("clean_digest"))


QUERIES = [chunk_documents, chunk_count_by_source, chunk_overlap_words, citation_labels, terms_exploded, term_frequency, document_frequency, incremental_index, streaming_index_search, corpus_stats, bm25_search, bm25_repeated_terms, bm25_file_filter, bm25_digest_prefix_filter, bm25_multi_query, query_file_filter_parse, adjacent_chunks, pack_direct, pack_prompt_first_kept, map_reduce_batches, select_retrieval, assemble_prompt, sanitize_delimiters]

_C = f"WITH c AS ({S.chunks()})"
_PACK = f"{_C} SELECT doc_key, ordinal, cost, CAST(running AS BIGINT) AS running_cost FROM (SELECT *, sum(cost) OVER w AS running, row_number() OVER w AS n FROM (SELECT *, {S.COST} AS cost FROM c) WINDOW w AS (PARTITION BY doc_key ORDER BY ordinal ROWS UNBOUNDED PRECEDING)) WHERE "
_MANY = f"""{_C},
    q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({S.terms('text')}) AS term FROM benchmark) GROUP BY ALL),
    p AS (SELECT doc_key, ordinal, term, dl, count(*) AS tf FROM (SELECT doc_key, ordinal, len(terms) AS dl, unnest(terms) AS term FROM c) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    s AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM c),
    h AS (SELECT query_id, doc_key, ordinal, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN d USING (term) JOIN q USING (term) CROSS JOIN s GROUP BY ALL)
    SELECT query_id, doc_key, ordinal, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal, doc_key) AS rank FROM h) WHERE rank <= 20"""
ESCAPED = "replace(replace({}, '=== BEGIN UNTRUSTED DOCUMENT CONTENT ===', '[escaped-delimiter: begin-untrusted-content]'), '=== END UNTRUSTED DOCUMENT CONTENT ===', '[escaped-delimiter: end-untrusted-content]')"

SQL = {
    "chunk_documents": f"{_C} SELECT doc_key, ordinal, chunk_id, token_count, sha256(text) AS text_digest, len(terms) AS n_terms FROM c",
    "chunk_count_by_source": f"{_C} SELECT source, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS n_tokens FROM c GROUP BY source",
    "chunk_overlap_words": f"{_C}, w AS (SELECT doc_key, ordinal, {S.words('text')} AS w FROM c) SELECT a.doc_key, a.ordinal, CASE WHEN list_slice(a.w, greatest(1, len(a.w) - 47), len(a.w)) = list_slice(b.w, 1, 48) THEN len(list_slice(b.w, 1, 48)) ELSE 0 END AS shared_words FROM w a JOIN w b ON a.doc_key = b.doc_key AND b.ordinal = a.ordinal + 1",
    "citation_labels": f"{_C} SELECT doc_key, ordinal, {S.LABEL} AS label, {S.COST} AS cost FROM c",
    "terms_exploded": f"{_C} SELECT doc_key, ordinal, count(*) AS n_terms, min(term) AS first_term, max(term) AS last_term FROM (SELECT doc_key, ordinal, unnest(terms) AS term FROM c) GROUP BY ALL",
    "term_frequency": f"{_C} SELECT doc_key, ordinal, term, count(*) AS tf FROM (SELECT doc_key, ordinal, unnest(terms) AS term FROM c) GROUP BY ALL",
    "document_frequency": f"{_C} SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_key, ordinal, term FROM (SELECT doc_key, ordinal, unnest(terms) AS term FROM c)) GROUP BY term",
    "incremental_index": f"{_C} SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_key, ordinal, term FROM (SELECT doc_key, ordinal, unnest(terms) AS term FROM c)) GROUP BY term",
    "corpus_stats": f"{_C} SELECT count(*) AS n_chunks, round(avg(len(terms)), 6) AS avgdl FROM c",
    "bm25_search": S.bm25(QUERY, 10),
    "streaming_index_search": S.bm25(QUERY, 10),
    "bm25_repeated_terms": S.bm25(REPEATED, 10),
    "bm25_file_filter": S.bm25(QUERY, 10, f"{S.lower('display_name')} = 'doc-11.txt' OR starts_with(digest, 'DOC-11.TXT')"),
    "bm25_digest_prefix_filter": S.bm25(QUERY, 10, "starts_with(digest, 'a')"),
    "bm25_multi_query": _MANY,
    "query_file_filter_parse": "SELECT conv_id, turn, 'Doc-' || turn || '.txt' AS file_filter, array_to_string(list_filter(regexp_split_to_array('@ ' || text || ' @later', '\\s+'), lambda w: w <> ''), ' ') AS query FROM conversations",
    "adjacent_chunks": f"WITH h AS ({S.bm25(QUERY, 10)}), n AS (SELECT DISTINCT doc_key, unnest([ordinal - 1, ordinal, ordinal + 1]) AS ordinal FROM h), c AS ({S.chunks()}) SELECT doc_key, ordinal, chunk_id FROM c SEMI JOIN n USING (doc_key, ordinal)",
    "pack_direct": f"{_PACK} running <= {BUDGET}",
    "pack_prompt_first_kept": f"{_PACK} running <= 100 OR n = 1",
    "map_reduce_batches": f"""WITH RECURSIVE c AS ({S.chunks()}), r AS (SELECT doc_key, ordinal, {S.COST} AS cost FROM c),
        b AS (SELECT doc_key, ordinal, cost, CAST(0 AS BIGINT) AS batch, CAST(cost AS BIGINT) AS held FROM r WHERE ordinal = 0
              UNION ALL SELECT r.doc_key, r.ordinal, r.cost, CASE WHEN held + r.cost > {BATCH} THEN batch + 1 ELSE batch END, CASE WHEN held + r.cost > {BATCH} THEN r.cost ELSE held + r.cost END
              FROM b JOIN r ON r.doc_key = b.doc_key AND r.ordinal = b.ordinal + 1)
        SELECT doc_key, ordinal, cost, batch FROM b""",
    "select_retrieval": f"""WITH RECURSIVE m AS ({_MANY}), c AS (SELECT doc_key, ordinal, chunk_id, digest, {S.COST} AS cost FROM ({S.chunks()})),
        k AS (SELECT query_id, doc_key, ordinal, chunk_id, cost, beside, row_number() OVER (PARTITION BY query_id ORDER BY rank, beside, ordinal) AS i
              FROM (SELECT query_id, rank, doc_key, unnest([ordinal - 1, ordinal, ordinal + 1]) AS ordinal, unnest([true, false, true]) AS beside FROM m) JOIN c USING (doc_key, ordinal)),
        s AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS taken, CAST(0 AS BIGINT) AS used, false AS stop, false AS active FROM k
              UNION ALL
              SELECT query_id, i, CASE WHEN add THEN list_append(taken, doc_key || ' ' || ordinal) ELSE taken END, CASE WHEN add THEN used + cost ELSE used END, stop, CASE WHEN beside THEN active ELSE add END
              FROM (SELECT *, NOT stop AND NOT seen AND used + cost <= {SELECT_BUDGET} AND (active OR NOT beside) AS add
                    FROM (SELECT k.*, taken, used, active, list_contains(taken, k.doc_key || ' ' || k.ordinal) AS seen, stop OR (NOT beside AND NOT list_contains(taken, k.doc_key || ' ' || k.ordinal) AND used + cost > {SELECT_BUDGET}) AS stop
                          FROM s JOIN k ON k.query_id = s.query_id AND k.i = s.i + 1))),
        t AS (SELECT query_id, unnest(taken) AS key FROM (SELECT query_id, arg_max(taken, i) AS taken FROM s GROUP BY query_id))
        SELECT query_id, doc_key, ordinal, chunk_id, cost, row_number() OVER (PARTITION BY query_id ORDER BY digest, ordinal, doc_key) AS read_at FROM t JOIN c ON key = doc_key || ' ' || ordinal""",
    "assemble_prompt": f"""{_C}, t AS (SELECT conv_id AS request_id, text AS query, greatest(0, 2048 - 512 - {SYSTEM_TOKENS} - {S.tokens('text')} - 50) AS room FROM conversations WHERE turn = 0),
        o AS (SELECT *, sum(cost) OVER w AS run, row_number() OVER w AS n FROM (SELECT request_id, room, ordinal, {S.LABEL} AS label, c.text, {S.COST} AS cost FROM t JOIN c ON doc_key = request_id) WINDOW w AS (PARTITION BY request_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING)),
        k AS (SELECT request_id, count(*) AS n, string_agg(label || chr(10) || {ESCAPED.format('text')} || chr(10) || chr(10), '' ORDER BY ordinal) AS parts FROM o WHERE run <= room OR n = 1 GROUP BY request_id),
        u AS (SELECT request_id, coalesce(n, 0) AS n, CASE WHEN parts IS NULL THEN '' ELSE '=== BEGIN UNTRUSTED DOCUMENT CONTENT ===' || chr(10) || parts || '=== END UNTRUSTED DOCUMENT CONTENT ===' || chr(10) || chr(10) END || query AS prompt FROM t LEFT JOIN k USING (request_id))
        SELECT request_id, sha256(prompt) AS prompt_digest, n AS n_included, {SYSTEM_TOKENS} + {S.tokens('prompt')} AS estimated_tokens FROM u""",
    "sanitize_delimiters": "SELECT doc_id, sha256('[escaped-delimiter: end-untrusted-content]' || text || '[escaped-delimiter: begin-untrusted-content]') AS clean_digest FROM documents",
}
