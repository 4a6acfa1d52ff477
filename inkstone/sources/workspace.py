"""Folders of files as DataFrames: a listing without contents, ignore rules, limits, and files read and written from tasks.

Tasks list folders in rounds and open only files that pass, in the stores that pyarrow opens; the driver holds no
file's name, however many there are. Names that begin with a dot are hidden and not walked into, names that aren't UTF-8
are passed over. Links are resolved by the store; one to a folder that it lies in isn't followed.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import tables

from . import discovery, formats, ignore

RULE_FILE = ".gitignore"
#: Columns of a listing; folders still to be listed have no length. Names that a task of the first round lists, four times
#: as many in each further one. Rows, and bytes of contents, that a task hands over at once.
LISTING = "path string, length bigint"
LISTED_AT_ONCE, BATCH_ROWS, BATCH_BYTES = 10_000, 10_000, 16 << 20


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out to all cores, for tables of names are small and what stands behind a name isn't."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def _leads_up(path: str) -> bool:
    """Whether a local path is a link to a folder that it lies in."""
    return os.path.islink(path) and f"{os.path.realpath(os.path.dirname(path))}/".startswith(f"{os.path.realpath(path)}/")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path (below root) and byte_size of every file below root that isn't hidden, empty ones too; no content is read."""
    base = tables.uri(spark, root)

    def look(most: int):
        """Lists folders and what lies in them; those that are left when a task has seen `most` names come out as folders."""
        from pyarrow import fs

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, home = _store(base)
            local, seen = isinstance(store, fs.LocalFileSystem), 0
            for batch in batches:
                left = batch.column(0).to_pylist()
                while left and seen < most:
                    folder = left.pop()
                    found = store.get_file_info(fs.FileSelector(f"{home}/{folder}".rstrip("/"), allow_not_found=bool(folder)))
                    seen += len(found)
                    for start in range(0, len(found), BATCH_ROWS):
                        paths, sizes = [], []
                        for info in found[start : start + BATCH_ROWS]:
                            try:
                                path = info.path
                            except UnicodeDecodeError:
                                continue
                            if path.rpartition("/")[2].startswith("."):
                                continue
                            if info.is_file:
                                paths.append(path[len(home) + 1 :])
                                sizes.append(info.size)
                            elif not (local and _leads_up(path)):
                                left.append(path[len(home) + 1 :])
                        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "length"])
                if left:
                    yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.nulls(len(left), pa.int64())], ["path", "length"])

        return work

    out = tables.work_dir(spark, "listing")
    folders, rounds = spark.createDataFrame([("",)], "path string").coalesce(1), []
    while not rounds or not folders.isEmpty():
        dealt = _spread(folders) if rounds else folders
        rounds.append(f"{out}/{len(rounds)}")
        dealt.mapInArrow(look(LISTED_AT_ONCE * 4 ** (len(rounds) - 1)), LISTING).write.parquet(rounds[-1])
        folders = spark.read.schema(LISTING).parquet(rounds[-1]).where("length IS NULL").select("path")
    return spark.read.schema(LISTING).parquet(*rounds).where("length IS NOT NULL").select("path", F.col("length").alias("byte_size"))


def rule_files(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """folder and content of the ignore files in the folders below root that files (path) lie in, or that stand above these;
    content that isn't UTF-8 counts as empty."""
    base = tables.uri(spark, root)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, home = _store(base)
        for batch in batches:
            folders, contents = [], []
            names = batch.column(0).to_pylist()
            for folder, info in zip(names, store.get_file_info([f"{home}/{n}/{RULE_FILE}" if n else f"{home}/{RULE_FILE}" for n in names]), strict=True):
                if info.is_file:
                    with store.open_input_stream(info.path) as f, contextlib.suppress(UnicodeDecodeError):
                        contents.append(f.read().decode("utf-8"))
                        folders.append(folder)
            yield pa.RecordBatch.from_arrays([pa.array(folders, pa.string()), pa.array(contents, pa.string())], ["folder", "content"])

    own = files.select(ignore.parent(F.col("path")).alias("folder")).distinct()
    above = own.select(F.explode(ignore.folders_above(F.col("folder"))).alias("folder")).distinct()
    return tables.settle(_spread(above).mapInArrow(look, "folder string, content string"), "rule-files")


def discovered(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """files (path, byte_size and more) that are not hidden and in no excluded folder or one that is left out, with format
    (null for unknown ones) and status: 'ignored', 'unsupported', 'oversized' or 'usable'."""
    seen = files.where(~discovery.hidden(F.col("path")) & ~discovery.excluded(F.col("path")))
    seen = ignore.judged(seen, rules) if rules is not None else seen.withColumn("ignored_by", F.lit(None).cast("string"))
    rows = seen.where("ignored_by IS NULL OR ignored_by <> 'folder'").withColumn("format", formats.from_path(F.col("path")))
    status = F.when(F.col("ignored_by").isNotNull(), "ignored").when(F.col("format").isNull(), "unsupported").when(F.col("byte_size") > discovery.MAX_FILE, "oversized").otherwise("usable")
    return rows.withColumn("status", status).drop("ignored_by")


def report(found: DataFrame, max_total: int = discovery.MAX_TOTAL, max_files: int = discovery.MAX_FILES) -> DataFrame:
    """One row over discovered files: n_files, total_bytes, ignored, oversized, within_limits."""
    usable = F.col("status") == "usable"
    sums = found.agg(
        F.count_if(usable).alias("n_files"), F.coalesce(F.sum(F.when(usable, F.col("byte_size"))), F.lit(0)).alias("total_bytes"),
        F.count_if(F.col("status") == "ignored").alias("ignored"), F.count_if(F.col("status") == "oversized").alias("oversized"),
    )
    return sums.withColumn("within_limits", discovery.within_limits(max_total, max_files))


def in_order(files: DataFrame) -> DataFrame:
    """Files by path, name by name."""
    return files.orderBy(F.split("path", "/"))


def read(spark: SparkSession, root: str, found: DataFrame) -> DataFrame:
    """path, format, byte_size, content of the usable files of found, a discovery of root. Only they are opened."""
    base = tables.uri(spark, root)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, home = _store(base)
        names = ["path", "format", "byte_size", "content"]
        for batch in batches:
            at, contents, held = 0, [], 0
            for n, path in enumerate(batch.column(0).to_pylist(), 1):
                with store.open_input_stream(f"{home}/{path}") as f:
                    contents.append(f.read())
                held += len(contents[-1])
                if held >= BATCH_BYTES or n == batch.num_rows:
                    part = batch.slice(at, n - at)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], names)
                    at, contents, held = n, [], 0

    usable = found.where("status = 'usable'").select("path", "format", "byte_size")
    return _spread(usable).mapInArrow(load, "path string, format string, byte_size bigint, content binary")


#: Why a file isn't written.
ESCAPES, REPEATED, DENIED = "path_escape", "repeated_path", "binary_source_overwrite_denied"


def _store(root: str):
    from pyarrow import fs

    if root.startswith("file:/"):  # as a path, for an address may not have spaces in it
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root)


def _outside(path: str | None) -> bool:
    return not path or path.startswith("/") or any(p in ("", ".", "..") for p in path.split("/"))


def write(files: DataFrame, root: str, allow_overwrite: bool = False) -> DataFrame:
    """Writes files (path, content) below root from tasks; path, byte_size, digest and error_code of each, when all are written.

    What may be written is settled first, so that a task's retry meets the same verdict and not its own files: paths that
    leave root and existing files of binary formats are refused, of rows that share a path all. Each file is written
    under a hidden name of its attempt and renamed, so readers and retries see whole files only."""
    spark = files.sparkSession
    base = tables.uri(spark, root)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, home = _store(base)
        for batch in batches:
            paths, formats_, many = (batch.column(i).to_pylist() for i in range(3))
            codes = []
            for path, fmt, n in zip(paths, formats_, many, strict=True):
                local = os.path.isdir(home)
                out = _outside(path) or local and os.path.commonpath([os.path.realpath(home), os.path.realpath(f"{home}/{path}")]) != os.path.realpath(home)
                there = not out and fmt is not None and fmt not in formats.EDITABLE and not allow_overwrite and store.get_file_info(f"{home}/{path}").is_file
                codes.append(ESCAPES if out else REPEATED if n > 1 else DENIED if there else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.string())], ["path", "error_code"])

    named = files.groupBy("path").agg(F.count("*").alias("n")).select("path", formats.from_path(F.col("path")).alias("format"), "n")
    verdicts = tables.settle(named.mapInArrow(check, "path string, error_code string"), "write-verdicts")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, home = _store(base)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            sizes, digests = [], []
            for path, content, error in zip(*(batch.column(i) for i in range(3)), strict=True):
                data = content.as_py() or b""
                if error.as_py() is None:
                    folder, _, name = f"{home}/{path.as_py()}".rpartition("/")
                    store.create_dir(folder, recursive=True)
                    early = f"{folder}/.{name}.{attempt}.tmp"
                    with store.open_output_stream(early) as f:
                        f.write(data)
                    store.move(early, f"{folder}/{name}")
                sizes.append(len(data) if error.as_py() is None else None)
                digests.append(hashlib.sha256(data).hexdigest() if error.as_py() is None else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), batch.column(2)], ["path", "byte_size", "digest", "error_code"])

    # a null path meets no verdict in a join by equality, so it is matched null-safely
    rows = files.select(F.col("path").alias("p"), F.col("content").cast("binary").alias("content")).join(verdicts, F.col("p").eqNullSafe(F.col("path"))).select("path", "content", "error_code")
    out = tables.settle(rows.mapInArrow(save, "path string, byte_size bigint, digest string, error_code string"), "written-files")
    tables.discard(verdicts)
    return out
