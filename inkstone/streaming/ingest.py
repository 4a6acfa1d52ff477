"""Structured Streaming: documents to chunks as files arrive, and an index that grows by batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkstone.functions import tables
from inkstone.functions import text as T
from inkstone.operators import bm25, chunking


def chunk_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """New document files as a stream of chunks; per-row work, so no state is kept."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return chunking.chunk_plain_text(chunking.as_files(docs))


def ingest_once(spark: SparkSession, path: str) -> DataFrame:
    """Runs the stream over all files there are and returns what it appended; exactly once by the sink's own log."""
    out = tables.work_dir(spark, "ingest")
    folder, _, name = path.rpartition("/")
    chunks = chunk_stream(spark, f"{folder}/[{name[0]}]{name[1:]}", spark.read.parquet(path).schema)  # a pattern may be a file or a folder
    query = chunks.writeStream.format("parquet").option("path", f"{out}/chunks").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(chunks.schema).parquet(f"{out}/chunks")


class TermIndex:
    """A BM25 index in a folder, to which batches are added: postings, and each batch's share of the document
    frequencies and of the corpus' size.

    A batch is written under its number, its mark last. One that stops midway leaves no mark: it isn't read, and its retry
    writes its folders anew. One that is there already is passed over, so a repeated batch changes nothing. Postings lie
    sorted by term in ranges, so a search reads only the row groups of its terms; a very frequent term goes over several."""

    POSTINGS = "doc_key bigint, ordinal bigint, dl int, term string, tf bigint, batch bigint"
    TERMS = "term string, df bigint, batch bigint"
    SIZES = "n_chunks bigint, n_terms bigint, batch bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def batches(self) -> list[int]:
        """The numbers of the batches that are wholly there."""
        if not tables.exists(self.spark, f"{self.path}/marks"):
            return []
        return sorted(r["batch"] for r in self.spark.read.schema("batch bigint").parquet(f"{self.path}/marks").collect())

    def add(self, chunks: DataFrame, batch: int) -> bool:
        """Adds chunks (doc_key, ordinal, terms) as a batch; false where it is there already."""
        if tables.exists(self.spark, f"{self.path}/marks/batch={batch}/_SUCCESS"):
            return False
        place = lambda part: f"{self.path}/{part}/batch={batch}"
        rows = chunks.select("doc_key", "ordinal", F.size("terms").alias("dl"), "terms")
        held = tables.settle(rows, "index-batch")  # a batch's documents are cut into chunks once
        counted = held.select("doc_key", "ordinal", "dl", F.inline(T.counted(F.col("terms"))))
        counted.repartitionByRange("term", "doc_key").sortWithinPartitions("term").write.mode("overwrite").parquet(place("postings"))
        written = self.spark.read.parquet(place("postings"))
        bm25.document_frequency(written).sort("term").write.mode("overwrite").parquet(place("terms"))
        held.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_terms")).write.mode("overwrite").parquet(place("sizes"))
        self.spark.range(1).select(F.lit(batch).cast("long").alias("number")).coalesce(1).write.mode("overwrite").parquet(place("marks"))
        tables.discard(held)
        return True

    def _read(self, part: str, schema: str) -> DataFrame:
        numbers = self.batches()
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}").where(F.col("batch").isin(numbers))

    def postings(self) -> DataFrame:
        return self._read("postings", self.POSTINGS)

    def document_frequency(self) -> DataFrame:
        """term, df over all batches."""
        return self._read("terms", self.TERMS).groupBy("term").agg(F.sum("df").alias("df"))

    def stats(self) -> DataFrame:
        """One row: n_chunks, avgdl."""
        sizes = self._read("sizes", self.SIZES)
        return sizes.agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"), (F.sum("n_terms") / F.sum("n_chunks")).alias("avgdl"))

    def search(self, query: str, limit: int, k1: float = bm25.K1, b: float = bm25.B) -> DataFrame:
        """The best chunks of a query: doc_key, ordinal, score (six decimals), best first."""
        wanted = bm25.query_terms(self.spark, query)
        terms = [r["term"] for r in wanted.collect()]  # a query is a parameter, not data
        df = self._read("terms", self.TERMS).where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("df").alias("df"))
        rows = self.postings().where(F.col("term").isin(terms))
        scored = rows.join(F.broadcast(df.join(wanted, "term")), "term").crossJoin(F.broadcast(self.stats()))  # one row a term of the query
        part = F.col("qtf") * bm25.idf(F.col("n_chunks"), F.col("df")) * bm25.weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
        hits = scored.groupBy("doc_key", "ordinal").agg(F.round(F.sum(part), 6).alias("score"))
        return hits.orderBy(F.desc("score"), "ordinal", "doc_key").limit(limit)

    def merged(self, path: str) -> TermIndex:
        """The index as one batch at another path, for when there are many small ones."""
        out = TermIndex(self.spark, path)
        self.postings().drop("batch").repartitionByRange("term", "doc_key").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{out.path}/postings/batch=0")
        self.document_frequency().sort("term").write.mode("overwrite").parquet(f"{out.path}/terms/batch=0")
        self._read("sizes", self.SIZES).agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_terms").alias("n_terms")).write.mode("overwrite").parquet(f"{out.path}/sizes/batch=0")
        self.spark.range(1).select(F.lit(0).cast("long").alias("number")).coalesce(1).write.mode("overwrite").parquet(f"{out.path}/marks/batch=0")
        return out


def index_stream(chunks: DataFrame, index: TermIndex, log: str) -> StreamingQuery:
    """Adds a stream of chunks to an index, a micro-batch at a time, over all there is."""
    return chunks.writeStream.foreachBatch(lambda rows, batch: index.add(rows, batch) and None).option("checkpointLocation", log).trigger(availableNow=True).start()
