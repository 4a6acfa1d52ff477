"""The block table: its schema, and the readers that fill it from files."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .guarded import DEADLINE, ReaderProcess

RUNS = "array<struct<kind: string, text: string, url: string>>"
BLOCK = f"kind string, level smallint, runs {RUNS}, ordered boolean, items array<{RUNS}>, headers array<string>, rows array<array<string>>, language string, code_text string, page int, description string, section string, line_start bigint, line_end bigint"
FIELDS = [f.split(" ")[0] for f in BLOCK.replace(f"array<{RUNS}>", "x").replace(RUNS, "x").split(", ")]

_RUN = pa.struct([("kind", pa.string()), ("text", pa.string()), ("url", pa.string())])
_TYPES = [pa.string(), pa.int16(), pa.list_(_RUN), pa.bool_(), pa.list_(pa.list_(_RUN)), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
_BLOCK = pa.struct(list(zip(FIELDS, _TYPES, strict=True)))


def anchor() -> Column:
    """Where a block stands in its file: page, section, its number and its lines."""
    return F.struct("page", "section", F.col("pos").alias("block_index"), "line_start", "line_end")


METADATA = ("title", "author", "created", "modified")


def read_metadata(files: DataFrame) -> DataFrame:
    """files: doc_key, format, content. doc_key, title, author, created and modified of every file; null what it lacks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(ReaderProcess()) as reader:
            for batch in batches:
                found = [reader("metadata", f.as_py(), c.as_py() or b"")[1] or {} for f, c in zip(batch.column(1), batch.column(2), strict=True)]  # read_blocks says why a file can't be read
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x.get(k) for x in found], pa.string()) for k in METADATA)], ["doc_key", *METADATA])

    return files.select("doc_key", "format", "content").mapInArrow(work, "doc_key bigint, " + ", ".join(f"{k} string" for k in METADATA))


def headings(blocks: DataFrame) -> DataFrame:
    """doc_key, pos, level, title, page, section and lines of every heading."""
    title = F.array_join(F.transform("runs", lambda r: F.coalesce(r["text"], F.lit(""))), "")
    return blocks.where("kind = 'heading'").select("doc_key", "pos", "level", title.alias("title"), "page", "section", "line_start", "line_end")


def read_blocks(files: DataFrame, deadline: float = DEADLINE) -> DataFrame:
    """files: doc_key, format, content. A row per block with pos, or one row with error_code where a file can't be read, or
    not within the deadline (seconds a file) and the readers' memory."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(ReaderProcess(deadline)) as reader:
            for batch in batches:
                read = [reader("read", f.as_py(), c.as_py() or b"") for f, c in zip(batch.column(1), batch.column(2), strict=True)]
                found = [[{k: b.get(k) for k in FIELDS} for b in blocks or []] for _, blocks in read]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e for e, _ in read], pa.string()), pa.array(found, pa.list_(_BLOCK))], ["doc_key", "error_code", "blocks"])

    schema = "doc_key bigint, error_code string, blocks array<struct<" + BLOCK.replace(" array<", ": array<").replace(" string", ": string").replace(" smallint", ": smallint").replace(" boolean", ": boolean").replace(" int,", ": int,").replace(" bigint", ": bigint").replace("::", ":") + ">>"
    read_ = files.select("doc_key", "format", "content").mapInArrow(work, schema)
    return read_.select("doc_key", "error_code", F.posexplode_outer("blocks").alias("pos", "b")).select("doc_key", "error_code", F.col("pos").cast("long").alias("pos"), "b.*")
