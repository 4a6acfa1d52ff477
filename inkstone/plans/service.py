"""Queries of a document service: uploads, source records, completion, grants, warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.operators import service
from inkstone.sources import discovery, ignore, multipart

from . import sql as S
from .documents import documents
from .retrieval import chunks

FOLDERS = ["", "sub/", ".git/", "models/", "a/node_modules/", "out/", ".hidden/"]
RULES = ["# files that are left out", "", "out/", "*.txt", "!d1*.txt", "/*/sub/d?.md", "**/models/*.PDF"]
TYPED = ["doc-1", "DOC-2", "c-33", "doc-", "zz"]


def upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads: names, media types and first bytes go round in turn."""
    turn = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    name = F.concat(F.lit("up\\load/d"), F.col("doc_id"), turn([".md", ".TXT", ".pdf", ".xlsx", ".rtf"]))
    kind = turn([None, "text/plain; charset=utf-8", "application/pdf", "application/octet-stream", "Text/RTF", "image/png", "text/markdown"])
    content = F.concat(turn(["%PDF-", "{\\rtf", ""]), F.coalesce("text", F.lit(""))).cast("binary")
    rows = documents(spark, sf_dir).select("doc_id", name.alias("filename"), kind.alias("content_type"), content.alias("content"))
    return rows.select("doc_id", service.base_name(F.col("filename")).alias("name"), service.upload_error(F.col("filename"), F.col("content_type"), F.col("content")).alias("error_code"))


def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.when(F.col("doc_key") % 3 == 0, F.col("ordinal") + 1)
    heading = F.when(F.col("doc_key") % 2 == 0, F.col("source"))
    return chunks(spark, sf_dir).select("doc_key", "ordinal", service.source_record(F.col("chunk_id"), F.col("display_name"), heading, page).alias("record"))


def name_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = documents(spark, sf_dir).select(F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt")).alias("name"))
    return service.complete(names, TYPED)


def granted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the sources that have a document longer than 20,000 characters, which stand for granted roots."""
    rows = documents(spark, sf_dir).select("doc_id", F.col("source").alias("root"), "n_chars")
    return service.writable(rows, rows.where("n_chars > 20000").select("root").distinct()).select("doc_id", "root")


def export_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks, of which every ninth stands for a chart."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    kind = F.when(F.col("n") % 9 == 4, F.lit("unsupported")).otherwise(F.lit("paragraph"))
    rows = rows.select("doc_id", "n", kind.alias("kind"), F.concat(F.lit("chart "), F.col("n"), F.lit(" of "), F.length("line")).alias("description"))
    return service.export_warnings(rows, "doc_id", "n").select("doc_id", F.size("warnings").cast("long").alias("n_warnings"), F.array_join("warnings", "; ").alias("warnings"))


def shown_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of documents' texts, by turns as bytes, kilobytes, megabytes and gigabytes."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") * F.pow(F.lit(1024), F.col("doc_id") % 4).cast("long")
    return documents(spark, sf_dir).select("doc_id", service.human_bytes(size).alias("shown"))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a workspace: by turns in a source, an excluded and a hidden folder, some too large."""
    turn = F.col("doc_id") % len(FOLDERS)
    folder = F.element_at(F.array(*(F.lit(f) for f in FOLDERS)), (turn + 1).cast("int"))
    ext = F.element_at(F.array(*(F.lit(e) for e in (".md", ".txt", ".exe", ".PDF", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat("source", F.lit("/"), folder, F.lit("d"), F.col("doc_id"), ext)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") * F.when(F.col("doc_id") % 13 == 0, 1 << 20).otherwise(1)
    return documents(spark, sf_dir).select("doc_id", path.alias("path"), size.alias("byte_size"))


def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.usable(_listed(spark, sf_dir)).select("doc_id", "path", "byte_size", "format")


def ignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir).select("doc_id", "path", discovery.ignored_by(F.col("path"), RULES).alias("ignored"))


def discovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.report(_listed(spark, sf_dir)).withColumn("within_limits", discovery.within_limits())


#: Folders of a workspace below each source, and what ignore files at the root, in each source and in two folders below say.
TREE = ["", "sub/", "sub/deep/", "out/", "logs/", "a/out/", "sub/out/"]
ROOT_RULES = "# all\n*.log\n\nlogs/\n/*/a/out/\n"
INNER_RULES = {"": "*.txt\r\n!d1*.txt\r\n  out/  \r\n", "sub": "!*.log\n! out/\nd?.md", "sub/deep": "*\n!*.md\n"}


def nested_ignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree with ignore files in four places of it, inner ones taking back what outer ones say."""
    folder = F.element_at(F.array(*(F.lit(f) for f in TREE)), (F.col("doc_id") % len(TREE) + 1).cast("int"))
    ext = F.element_at(F.array(*(F.lit(e) for e in (".md", ".txt", ".log", ".PDF", ".rtf"))), (F.col("doc_id") % 5 + 1).cast("int"))
    files = documents(spark, sf_dir).select("doc_id", F.concat("source", F.lit("/"), folder, F.lit("d"), F.col("doc_id"), ext).alias("path"))
    said = F.array(*(F.struct(F.lit(f).alias("inner"), F.lit(c).alias("content")) for f, c in INNER_RULES.items()))
    inner = documents(spark, sf_dir).select("source").distinct().select("source", F.inline(said))
    rule_files = inner.select(F.when(F.col("inner") == "", F.col("source")).otherwise(F.concat("source", F.lit("/"), "inner")).alias("folder"), "content")
    rule_files = rule_files.unionByName(spark.range(1).select(F.lit("").alias("folder"), F.lit(ROOT_RULES).alias("content")))
    return ignore.judged(files, rule_files).select("doc_id", "path", "ignored_by")


BOUNDARY = "cut.here+17"


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as upload requests: a note, the text as a file, an unnamed part. Line ends go by turns of two, faults by
    turns of eleven: no boundary named, no closing boundary, no parts between; texts have lines like boundaries in them."""
    turn, end = F.col("doc_id") % 11, F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\n")
    mark = F.lit(f"--{BOUNDARY}")
    text = F.concat(F.lit("--cut.here"), end, F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), end), end, F.lit("--"))
    part = lambda head, data: F.concat(mark, end, head, end, end, data, end)
    note = part(F.lit('Content-Disposition: form-data; name="note"'), F.col("lang"))
    file = part(F.concat(F.lit('CONTENT-disposition: form-data; name="file"; filename="dir/d'), F.col("doc_id"), F.lit('.txt"'), end, F.lit("content-type:  text/plain; charset=utf-8 ")), text)
    lost = part(F.lit("Content-Disposition: form-data"), F.lit("nobody's"))
    body = F.when(turn == 3, F.concat(mark, end, note.substr(F.lit(1), F.lit(0)))).when(turn == 4, F.concat(mark, F.lit("--"), end, mark, F.lit("--"))).otherwise(F.concat(F.lit("before"), end, note, file, lost, mark, F.lit("--"), end))
    kind = F.when(turn == 2, F.lit("multipart/form-data")).when(turn == 5, F.lit(f'multipart/form-data; charset=x; boundary="{BOUNDARY}"')).otherwise(F.lit(f"multipart/form-data; boundary={BOUNDARY} "))
    return documents(spark, sf_dir).select(F.col("doc_id").alias("request_id"), kind.alias("content_type"), body.cast("binary").alias("body"))


def multipart_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = multipart.parts(_forms(spark, sf_dir))
    return rows.select("request_id", F.col("part").cast("long").alias("part"), "name", "filename", "content_type", F.sha2("data", 256).alias("data_digest"), F.octet_length("data").cast("long").alias("n_bytes"), "error_code")


def multipart_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What uploads the requests above hold, and whether they are taken."""
    rows = multipart.upload(multipart.parts(_forms(spark, sf_dir)))
    return rows.select("request_id", service.base_name(F.col("filename")).alias("name"), service.upload_error(F.col("filename"), F.col("content_type"), F.col("data")).alias("error_code"))


def settings_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as settings files: their source and language as workspace and profile, faults by turns of nine."""
    turn = F.col("doc_id") % 9
    profile = lambda name: F.struct(name.alias("name"), F.lit("https://x.example/v1/").alias("base_url"), F.col("source").alias("model"))
    body = F.to_json(F.struct(
        F.when(turn == 2, 2).otherwise(1).alias("schema_version"),
        F.when(turn.isin(1, 3), F.array(F.concat(F.when(turn == 1, "/w/").otherwise("w/"), "source"))).alias("write_workspaces"),
        F.when(turn == 1, F.array(profile(F.col("lang")))).when(turn == 4, F.array(profile(F.col("lang")), profile(F.col("lang")))).when(turn == 7, F.array(profile(F.lit("")))).alias("remote_profiles"),
        F.when(turn == 5, F.col("lang")).alias("theme"),
    ))
    text = F.when(turn == 6, F.rpad(body, 70_000, " ")).when(turn == 8, F.concat(F.lit("{"), F.coalesce("text", F.lit("")))).otherwise(body)
    return documents(spark, sf_dir).select("doc_id", service.settings_valid(text).alias("valid"))


QUERIES = [settings_checks, nested_ignored_files, multipart_parts, multipart_uploads, upload_validation, source_records, name_completion, granted_documents, export_warnings, shown_sizes, discover_files, ignored_files, discovery_report]

_FILES = """SELECT doc_id, source || '/' || ['', 'sub/', '.git/', 'models/', 'a/node_modules/', 'out/', '.hidden/'][doc_id % 7 + 1] || 'd' || doc_id || ['.md', '.txt', '.exe', '.PDF', ''][doc_id % 5 + 1] AS path,
    strlen(text) * CASE WHEN doc_id % 13 = 0 THEN 1048576 ELSE 1 END AS byte_size, ['md', 'txt', NULL, 'pdf', NULL][doc_id % 5 + 1] AS format, doc_id % 7 IN (0, 1, 5) AND doc_id % 5 IN (0, 1, 3) AS usable FROM documents"""
_ASKED = ", ".join(f"('{t}')" for t in TYPED)
_FORMS = """SELECT doc_id, lang, doc_id % 11 AS turn, '--cut.here' || e || replace(text, chr(10), e) || e || '--' AS body
    FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN chr(13) || chr(10) ELSE chr(10) END AS e FROM documents)"""
SQL = {
    "settings_checks": "SELECT doc_id, doc_id % 9 IN (0, 1) AS valid FROM documents",
    "multipart_parts": f"""WITH f AS ({_FORMS})
        SELECT doc_id AS request_id, CAST(0 AS BIGINT) AS part, 'note' AS name, NULL AS filename, NULL AS content_type, sha256(lang) AS data_digest, strlen(lang) AS n_bytes, NULL AS error_code FROM f WHERE turn NOT IN (2, 3, 4)
        UNION ALL SELECT doc_id, 1, 'file', 'dir/d' || doc_id || '.txt', 'text/plain; charset=utf-8', sha256(body), strlen(body), NULL FROM f WHERE turn NOT IN (2, 3, 4)
        UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, ['no_boundary', 'malformed', 'no_parts'][turn - 1] FROM f WHERE turn IN (2, 3, 4)""",
    "multipart_uploads": "SELECT doc_id AS request_id, 'd' || doc_id || '.txt' AS name, NULL AS error_code FROM documents WHERE doc_id % 11 NOT IN (2, 3, 4)",
    "nested_ignored_files": """SELECT doc_id, path, CASE WHEN f IN (3, 4, 5) THEN 'folder'
            WHEN f = 2 AND e <> 0 OR f = 0 AND e = 2 OR f IN (0, 1, 6) AND e = 1 AND NOT starts_with(CAST(doc_id AS VARCHAR), '1') OR f IN (1, 6) AND e = 0 AND doc_id < 10 THEN 'file' END AS ignored_by
        FROM (SELECT doc_id, doc_id % 7 AS f, doc_id % 5 AS e, source || '/' || ['', 'sub/', 'sub/deep/', 'out/', 'logs/', 'a/out/', 'sub/out/'][doc_id % 7 + 1] || 'd' || doc_id || ['.md', '.txt', '.log', '.PDF', '.rtf'][doc_id % 5 + 1] AS path FROM documents)""",
    "upload_validation": """SELECT doc_id, 'd' || doc_id || ['.md', '.TXT', '.pdf', '.xlsx', '.rtf'][doc_id % 5 + 1] AS name,
        CASE WHEN doc_id % 3 = 2 AND text = '' THEN 'empty_file' WHEN doc_id % 5 = 3 THEN 'unsupported_format'
             WHEN doc_id % 5 = 2 AND doc_id % 3 <> 0 OR doc_id % 5 = 4 AND doc_id % 3 <> 1 THEN 'signature_mismatch'
             WHEN doc_id % 7 IN (0, 3) THEN NULL
             WHEN doc_id % 5 = 0 AND doc_id % 7 NOT IN (1, 6) OR doc_id % 5 = 1 AND doc_id % 7 <> 1 OR doc_id % 5 = 2 AND doc_id % 7 <> 2 OR doc_id % 5 = 4 AND doc_id % 7 <> 4 THEN 'media_type_mismatch' END AS error_code
        FROM documents""",
    "source_records": f"WITH c AS ({S.chunks()}) SELECT doc_key, ordinal, '{{\"id\":\"' || chunk_id || '\",\"file\":\"' || display_name || '\"' || CASE WHEN doc_key % 2 = 0 THEN ',\"heading\":\"' || source || '\"' ELSE '' END || CASE WHEN doc_key % 3 = 0 THEN ',\"page\":' || (ordinal + 1) ELSE '' END || '}}' AS record FROM c",
    "name_completion": f"SELECT query, n_matches, CASE WHEN lo = hi THEN lo ELSE substr(lo, 1, CAST(list_max(list_filter(range(least(length(lo), length(hi)) + 1), lambda n: substr(lo, 1, n) = substr(hi, 1, n))) AS BIGINT)) END AS common FROM (SELECT query, count(*) AS n_matches, min(name) AS lo, max(name) AS hi FROM (SELECT 'doc-' || doc_id || '.txt' AS name FROM documents) JOIN (VALUES {_ASKED}) t(query) ON starts_with(name, query) OR contains(lower(name), lower(query)) GROUP BY query)",
    "granted_documents": "SELECT doc_id, source AS root FROM documents WHERE source IN (SELECT source FROM documents WHERE n_chars > 20000)",
    "export_warnings": "SELECT doc_id, count(*) AS n_warnings, string_agg('not exported: chart ' || n || ' of ' || length(line), '; ' ORDER BY n) AS warnings FROM (SELECT doc_id, unnest(t) AS line, unnest(range(len(t))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)) WHERE n % 9 = 4 GROUP BY doc_id",
    "shown_sizes": "SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.2f GiB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MiB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024.0) ELSE n || ' bytes' END AS shown FROM (SELECT doc_id, CAST(strlen(text) * power(1024, doc_id % 4) AS BIGINT) AS n FROM documents)",
    "discover_files": f"SELECT doc_id, path, byte_size, format FROM ({_FILES}) WHERE usable AND byte_size <= 52428800",
    "ignored_files": f"SELECT doc_id, path, doc_id % 7 = 5 OR (doc_id % 5 = 1 AND CAST(doc_id AS VARCHAR) NOT LIKE '1%') OR (doc_id % 7 = 1 AND doc_id % 5 = 0 AND doc_id < 10) OR (doc_id % 7 = 3 AND doc_id % 5 = 3) AS ignored FROM ({_FILES})",
    "discovery_report": f"SELECT count(*) FILTER (byte_size <= 52428800) AS n_files, CAST(coalesce(sum(byte_size) FILTER (byte_size <= 52428800), 0) AS BIGINT) AS total_bytes, count(*) FILTER (byte_size > 52428800) AS oversized, count(*) FILTER (byte_size <= 52428800) <= 10000 AND coalesce(sum(byte_size) FILTER (byte_size <= 52428800), 0) <= 262144000 AS within_limits FROM ({_FILES}) WHERE usable",
}
