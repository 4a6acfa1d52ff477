"""Queries over documents as files and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.sources import formats

from . import sql as S

#: Every line of a document as a paragraph of its own.
SPACED = "replace(text, chr(10), chr(10) || chr(10))"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_source_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents(spark, sf_dir).select("doc_id", T.digest(text).alias("digest"), F.octet_length(text).cast("long").alias("byte_size"))


def doc_duplicate_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_source_digest(spark, sf_dir)
    return rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


def doc_word_char_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents(spark, sf_dir).select("doc_id", T.word_count(text).alias("n_words"), F.length(text).cast("long").alias("n_code_points"), T.approx_tokens(text).alias("n_tokens"))


def doc_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("lang", T.word_count(F.coalesce("text", F.lit(""))).alias("w"), F.length(F.coalesce("text", F.lit(""))).alias("c"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("w").alias("n_words"), F.sum("c").cast("long").alias("n_code_points"), F.max("w").alias("longest"))


def plain_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")).alias("text"))
    return formats.plain_text_blocks(rows).select("doc_id", "pos", "text", "line_start", "line_end")


def plain_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = plain_text_blocks(spark, sf_dir)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda b: b["text"]), "\n\n")
    return blocks.groupBy("doc_id").agg(joined.alias("text")).select("doc_id", T.digest(F.col("text")).alias("digest"), F.length("text").cast("long").alias("n_code_points"))


def validate_text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: every seventh emptied, every eleventh given a NUL, every thirteenth a PDF signature."""
    text = F.coalesce("text", F.lit(""))
    body = F.when(F.col("doc_id") % 7 == 0, F.lit("")).when(F.col("doc_id") % 11 == 0, F.concat(text, F.lit("\0"))).when(F.col("doc_id") % 13 == 0, F.concat(F.lit("%PDF-1.4\n"), text)).otherwise(text)
    fmt = F.when(F.col("doc_id") % 2 == 0, F.lit("txt")).otherwise(F.lit("pdf"))
    rows = documents(spark, sf_dir).select("doc_id", body.cast("binary").alias("content"), fmt.alias("format"))
    return rows.select("doc_id", "format", formats.validation_error(F.col("content"), F.col("format")).alias("error_code"))


def format_from_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of file names made of the documents' ids and sources."""
    ext = F.element_at(F.array(*(F.lit(x) for x in formats.SAMPLE_EXTENSIONS)), (F.col("doc_id") % len(formats.SAMPLE_EXTENSIONS) + 1).cast("int"))
    rows = documents(spark, sf_dir).select("doc_id", F.concat("source", F.lit("/Doc."), F.col("doc_id"), ext).alias("path"))
    return rows.select("doc_id", "path", formats.from_path(F.col("path")).alias("format"))


def format_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = format_from_extension(spark, sf_dir)
    flags = [formats.is_editable(F.col("format")).alias("editable"), formats.is_exportable(F.col("format")).alias("exportable"), formats.is_legacy(F.col("format")).alias("legacy")]
    return rows.groupBy("format").agg(F.count("*").alias("n_files")).select("format", "n_files", *flags)


def sniff_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures put before the documents' texts."""
    heads = F.array(*(F.unhex(F.lit(x)) for x in formats.SAMPLE_HEADS))
    text = F.coalesce("text", F.lit("")).cast("binary")
    content = F.concat(F.element_at(heads, (F.col("doc_id") % len(formats.SAMPLE_HEADS) + 1).cast("int")), text)
    return documents(spark, sf_dir).select("doc_id", formats.sniff(content).alias("format"))


QUERIES = [doc_source_digest, doc_duplicate_digests, doc_word_char_token_counts, doc_stats_by_lang, plain_text_blocks, plain_text_roundtrip, validate_text_bytes, format_from_extension, format_capabilities, sniff_magic]

_BLOCKS = f"""
    SELECT doc_id, CAST(pos AS BIGINT) AS pos, text, CAST(line_start AS BIGINT) AS line_start, CAST(line_start + n - 1 AS BIGINT) AS line_end FROM (
      SELECT doc_id, i, {S.trim("piece")} AS text, n, 1 + coalesce(sum(CASE WHEN {S.trim("piece")} = '' THEN 2 ELSE n + 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start,
             sum(CASE WHEN {S.trim("piece")} = '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos
      FROM (SELECT doc_id, piece, i, greatest(1, len({S.lines("piece")})) AS n
            FROM (SELECT doc_id, unnest(string_split({SPACED}, chr(10) || chr(10))) AS piece, unnest(range(len(string_split({SPACED}, chr(10) || chr(10))))) AS i FROM documents))
    ) WHERE text <> ''"""
_EXT = "CASE doc_id % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.pdf' WHEN 3 THEN '.Docx' WHEN 4 THEN '.html' ELSE '.odt' END"
_FORMATS = f"SELECT doc_id, path, CASE regexp_extract(lower(path), '\\.([a-z]+)$', 1) WHEN 'md' THEN 'md' WHEN 'txt' THEN 'txt' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'odt' THEN 'odt' END AS format FROM (SELECT doc_id, source || '/Doc.' || doc_id || {_EXT} AS path FROM documents)"

SQL = {
    "doc_source_digest": "SELECT doc_id, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS byte_size FROM documents",
    "doc_duplicate_digests": "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "doc_word_char_token_counts": f"SELECT doc_id, len({S.words('text')}) AS n_words, length(text) AS n_code_points, {S.tokens('text')} AS n_tokens FROM documents",
    "doc_stats_by_lang": f"SELECT lang, count(*) AS n_docs, CAST(sum(len({S.words('text')})) AS BIGINT) AS n_words, CAST(sum(length(text)) AS BIGINT) AS n_code_points, max(len({S.words('text')})) AS longest FROM documents GROUP BY lang",
    "plain_text_blocks": _BLOCKS,
    "plain_text_roundtrip": f"SELECT doc_id, sha256(t) AS digest, length(t) AS n_code_points FROM (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS t FROM ({_BLOCKS}) GROUP BY doc_id)",
    "validate_text_bytes": "SELECT doc_id, format, CASE WHEN doc_id % 7 = 0 OR text = '' AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 THEN 'empty_file' WHEN format = 'pdf' AND (doc_id % 13 <> 0 OR doc_id % 11 = 0) THEN 'signature_mismatch' WHEN format = 'txt' AND doc_id % 11 = 0 THEN 'invalid_encoding' END AS error_code FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'txt' ELSE 'pdf' END AS format FROM documents)",
    "format_from_extension": _FORMATS,
    "format_capabilities": f"SELECT format, n_files, format IN ('md', 'txt') AS editable, format IN ('md', 'txt', 'docx', 'rtf', 'odt') AS exportable, format = 'doc' AS legacy FROM (SELECT format, count(*) AS n_files FROM ({_FORMATS}) GROUP BY format)",
    "sniff_magic": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'rtf' WHEN 2 THEN 'doc' WHEN 3 THEN 'docx' WHEN 4 THEN 'odt' END AS format FROM documents",
}
