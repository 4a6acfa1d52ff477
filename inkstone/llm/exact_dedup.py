"""Exact deduplication against a persistent digest index, in DataFrame operations only.

The index is a folder of rows (digest, keep_id), bucketed and sorted by digest; any session opens it again by its path.
New data comes in batches. A batch is first reduced to one row per digest, with partial aggregation in front of the
shuffle, so copies of one text never meet in a single task. The digests that the index lacks are found by a sort-merge
anti-join, which leaves the index where it lies, and are appended. Verdicts reach the rows by a join on the digest whose
other side is unique, which adaptive execution can split where one digest is hot.

A table without an earlier index is added in ranges of doc_id, the largest first, so that of equal texts the largest
doc_id enters the index and all later ranges pass the anti-join.

Defined results: a null text counts as empty, and texts of any length are read whole; texts are equal when identical
after lower-casing A-Z; of equal texts the row with the largest doc_id stays, a null doc_id counting as the smallest; of
rows that repeat both, one stays; what an earlier call has put into the index stays there and no row of a later call
with that text is kept; a call that repeats an earlier one's batch name, because that stopped midway or not, gives the
result that the earlier one gives; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, beside_row, delete, discard, exists, new_path, settle_at

#: Stands for a null doc_id in joins.
NO_ID = -(2**63)
#: Ranges of doc_id in which a table is added to an index.
RANGES = 2
ENTRY = "digest string, keep_id bigint"


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, digest and a number of every row."""
    text = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(doc_id.alias("doc_id"), F.sha2(text, 256).alias("digest"), F.monotonically_increasing_id().alias("row"))


class DigestIndex:
    """The index at a path: entries bucketed and sorted by digest, and the number of buckets beside them."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        if exists(spark, f"{self.path}/spec"):
            buckets = spark.read.parquet(f"{self.path}/spec").first()["buckets"]
        else:
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{self.path}/spec")
        self.buckets = buckets
        self.table = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        if not spark.catalog.tableExists(self.table):  # a catalogue that doesn't know the folder yet
            spark.sql(f"CREATE TABLE {self.table} ({ENTRY}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/entries'")

    def read(self) -> DataFrame:
        """The entries, with their buckets known to the planner."""
        return self.spark.table(self.table)

    def entries(self) -> DataFrame:
        """The entries as plain files: a join with them deals both sides out anew, so that a hot digest can be split."""
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/entries") if exists(self.spark, f"{self.path}/entries") else self.spark.createDataFrame([], ENTRY)

    def add(self, batch: DataFrame, place: str) -> DataFrame:
        """Appends the digests of batch (doc_id, digest, row) that are new; returns them: (digest, keep_id, keep_row).

        They are written at place first and appended last. A call that is repeated with the same place finds them there,
        appends what the index still lacks of them, and returns the same."""
        schema = f"{ENTRY}, keep_row bigint"
        again = exists(self.spark, f"{place}/new/_SUCCESS")
        if not again:
            top = batch.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top")).select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"))
            settle_at(top.join(self.read().select("digest").hint("merge"), "digest", "left_anti"), f"{place}/new")
        new = self.spark.read.schema(schema).parquet(f"{place}/new")
        if not exists(self.spark, f"{place}/appended/_SUCCESS"):
            self._append(new.join(self.read().select("digest").hint("merge"), "digest", "left_anti") if again else new)
            settle_at(self.spark.range(1), f"{place}/appended")
        return new

    def _append(self, new: DataFrame) -> None:
        placed = new.select("digest", "keep_id").repartition(self.buckets, "digest")
        placed.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").option("path", f"{self.path}/entries").saveAsTable(self.table)

    def drop(self) -> None:
        """Removes the index, its table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete(self.spark, self.path)


def _ranges(rows: DataFrame, n: int) -> list[DataFrame]:
    """rows in n ranges of doc_id, the largest first; null ids are in the last."""
    low, high = rows.where(F.col("doc_id") != NO_ID).agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None or low == high or n < 2:
        return [rows]
    bounds = sorted({low + (high - low) * k // n for k in range(1, n)}, reverse=True)
    above = [None, *bounds]
    return [rows.where((F.col("doc_id") >= lo if lo is not None else F.lit(True)) & (F.col("doc_id") < hi if hi is not None else F.lit(True))) for hi, lo in zip(above, [*bounds, None], strict=True)]


def added(docs: DataFrame, index: DigestIndex | None = None, ranges: int = RANGES, batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Adds docs to the index. Gives the rows (doc_id, digest, row) and a verdict for each digest of theirs: (digest,
    keep_id, keep_row, group_size); keep_row is null where an earlier call has the text. Without an index a new one
    serves this call alone.

    batch names the call: one with a name that the index knows goes on where the earlier one stopped and gives its result,
    whatever docs are then. All that a named call finds lies beside the index."""
    spark = docs.sparkSession
    own = index is None
    index = index or DigestIndex(spark, new_path(spark, "digest-index"))
    home = f"{index.path}/batches/{batch}" if batch is not None and not own else new_path(spark, "digest-batch")
    if not exists(spark, f"{home}/rows/_SUCCESS"):
        settle_at(digested(docs), f"{home}/rows")
    rows = spark.read.schema("doc_id bigint, digest string, row bigint").parquet(f"{home}/rows")
    if not exists(spark, f"{home}/verdicts/_SUCCESS"):
        entered = None
        for k, part in enumerate(_ranges(rows, ranges)):
            new = index.add(part, f"{home}/{k}")
            entered = new if entered is None else entered.unionByName(new)
        sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
        verdict = sizes.join(index.entries(), "digest").join(entered.select("digest", "keep_row"), "digest", "left")
        settle_at(verdict.select("digest", "keep_id", "keep_row", "group_size"), f"{home}/verdicts")
        discard(entered)
    verdict = spark.read.schema(f"{ENTRY}, keep_row bigint, group_size bigint").parquet(f"{home}/verdicts")
    if own:
        index.drop()
    return rows, verdict


def resolve(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, verdict = added(docs, index, batch=batch)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept")
    return rows.join(verdict, "digest").select(real("doc_id"), real("keep_id"), "group_size", kept, F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """docs without the rows whose text another row, or an earlier entry of the index, holds; all columns as they were."""
    _, verdict = added(docs, index, batch=batch)
    keep = verdict.where("keep_row IS NOT NULL").select("digest", F.col("keep_id").alias("id"))
    text = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    marked = beside_row(docs, digest=F.sha2(text, 256), id=F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    return marked.join(keep, ["digest", "id"]).dropDuplicates(["digest", "id"]).select("row.*")


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY sha256(t) ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW same AS (PARTITION BY sha256(t))
"""
