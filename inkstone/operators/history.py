"""Conversations: bounded histories, chat requests, transcripts, carried headings and pages, event lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T

MAX_MESSAGES, MAX_BYTES = 512, 1_048_576


def bounded(messages: DataFrame, max_messages: int = MAX_MESSAGES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """conv_id, turn, accepted, history_bytes: a message that would pass a bound is refused, later ones may still fit.

    What is accepted depends on all before it, so each conversation is folded in order of its turns. Sizes come, not texts."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes")
    items = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), size))).alias("items"))

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            accepted, held = [], []
            for items in table.column(1):
                count = used = 0
                for size in items.values.field("bytes").to_pylist():
                    fits = count < max_messages and size <= max_bytes - used
                    count, used = count + fits, used + size * fits
                    accepted.append(fits)
                    held.append(used)
            items = table.column(1)
            key, turn = table.column(0).take(pc.list_parent_indices(items)), pc.list_flatten(items).field("turn")
            yield pa.RecordBatch.from_arrays([key, turn, pa.array(accepted, pa.bool_()), pa.array(held, pa.int64())], ["conv_id", "turn", "accepted", "history_bytes"])

    return items.mapInArrow(work, f"conv_id {messages.schema['conv_id'].dataType.simpleString()}, turn bigint, accepted boolean, history_bytes bigint")


def chat_requests(messages: DataFrame) -> DataFrame:
    """conv_id, preferences (system texts joined by blank lines, else null) and query (the last user text, else empty)."""
    role = lambda name: F.when(F.col("role") == name, F.struct("turn", "text"))
    system = F.transform(F.sort_array(F.collect_list(role("system"))), lambda m: m["text"])
    folded = messages.groupBy("conv_id").agg(system.alias("system"), F.max(role("user")).alias("user"))
    return folded.select("conv_id", F.when(F.size("system") > 0, F.array_join("system", "\n\n")).alias("preferences"), F.coalesce("user.text", F.lit("")).alias("query"))


#: What stands before a role's paragraphs in a transcript.
PREFIXES = {"user": "User: ", "assistant": "Assistant: "}


def transcript_blocks(messages: DataFrame, title: str) -> DataFrame:
    """conv_id, pos, kind, prefix, text: a title, then a paragraph for each piece between blank lines."""
    prefix = F.create_map(*(F.lit(x) for pair in PREFIXES.items() for x in pair))
    parts = messages.select("conv_id", "turn", F.coalesce(F.try_element_at(prefix, F.col("role")), F.lit("Notice: ")).alias("prefix"), F.posexplode(T.paragraphs(F.coalesce("text", F.lit("")))).alias("n", "text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "n")
    body = parts.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), F.lit("paragraph").alias("kind"), "prefix", "text")
    head = messages.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("heading").alias("kind"), F.lit(None).cast("string").alias("prefix"), F.lit(title).alias("text"))
    return head.unionByName(body)


def carry_heading(blocks: DataFrame, group: str, position: str) -> DataFrame:
    """Adds nearest_heading: the text of the last heading at or before each block."""
    window = Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("nearest_heading", F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(window))


def carry_page(blocks: DataFrame, group: str, position: str) -> DataFrame:
    """Adds carried_page: a block's own page, else that of the last block or page break before it."""
    window = Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("carried_page", F.coalesce("page", F.last("page", ignorenulls=True).over(window)))


def committed(answers: DataFrame) -> DataFrame:
    """The answers (of decode_events) that enter a history: finished and within their bounds; others leave nothing behind."""
    return answers.where(F.col("finished") & ~F.col("too_long"))


def decode_events(lines: DataFrame, max_line: int = 262_144, max_answer: int = 1_048_576, max_stream: int = 8_388_608) -> DataFrame:
    """stream_id, answer, finished, too_long from event lines (stream_id, seq, line): data: JSON deltas up to [DONE].

    too_long: a line, the answer or all lines of the stream together pass their bound, in bytes."""
    body = F.regexp_extract("line", r"^data:\s?(.*)$", 1)
    delta = F.get_json_object(body, "$.choices[0].delta.content")
    rows = lines.where(F.startswith("line", F.lit("data:"))).select("stream_id", "seq", (body == "[DONE]").alias("done"), F.coalesce(delta, F.lit("")).alias("delta"), (F.octet_length("line") > max_line).alias("long"), F.octet_length("line").cast("long").alias("size"))
    end = F.min(F.when(F.col("done"), F.col("seq")))
    parts = rows.groupBy("stream_id").agg(end.alias("stop"), F.sort_array(F.collect_list(F.struct("seq", "delta"))).alias("parts"), (F.max("long") | (F.sum("size") > max_stream)).alias("long"))
    kept = F.filter("parts", lambda p: F.col("stop").isNull() | (p["seq"] < F.col("stop")))
    answer = F.array_join(F.transform(kept, lambda p: p["delta"]), "")
    return parts.select("stream_id", answer.alias("answer"), F.col("stop").isNotNull().alias("finished"), (F.col("long") | (F.octet_length(answer) > max_answer)).alias("too_long"))
