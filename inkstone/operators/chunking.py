"""Chunks of documents: paragraphs, long ones cut into overlapping windows of words. No shuffle: all of it is per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.sources.blocks import anchor

from . import history, render

MAX_TOKENS, OVERLAP_TOKENS = 512, 64


def window_words(max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> tuple[int, int]:
    """Words of a window and the step to the next one."""
    size = max(1, max_tokens * 3 // 4)
    return size, size - min(overlap * 3 // 4, size // 2)


def split_long(paragraph: Column, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """The paragraph itself, or its windows when it has too many tokens."""
    size, step = window_words(max_tokens, overlap)

    def windows(w: Column) -> Column:
        count = F.when(F.size(w) <= size, 1).otherwise(F.ceil((F.size(w) - size) / F.lit(float(step))) + 1).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))

    cut = F.flatten(F.transform(F.array(T.words(paragraph)), windows))  # the outer transform splits the words once
    return F.when(T.approx_tokens(paragraph) <= max_tokens, F.array(paragraph)).otherwise(cut)


def as_files(docs: DataFrame) -> DataFrame:
    """Rows of documents as plain-text files."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").alias("doc_key"), T.digest(text).alias("digest"), F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt")).alias("display_name"), text.alias("text"), "lang", "source")


def chunk_plain_text(files: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """doc_key, digest, display_name, ordinal, chunk_id, token_count, text, terms and the other columns of files."""
    keep = [c for c in files.columns if c != "text"]
    pieces = F.flatten(F.transform(T.paragraphs(F.col("text")), lambda p: split_long(p, max_tokens, overlap)))
    out = files.select(*keep, F.posexplode(pieces).alias("ordinal", "text"))
    return out.select(
        *keep,
        F.col("ordinal").cast("long").alias("ordinal"),
        F.concat(F.substring("digest", 1, 8), F.lit(":c"), F.col("ordinal")).alias("chunk_id"),
        T.approx_tokens(F.col("text")).alias("token_count"),
        "text",
        T.terms(F.col("text")).alias("terms"),
    )


def chunk_blocks(blocks: DataFrame, sources: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Chunks of the block table: a heading, a paragraph or its windows, a list, code in its fence, a table or its runs of
    rows. Every chunk carries the nearest heading and the page at or before it. sources: doc_key, digest, display_name.

    Headings and pages are carried, and chunks numbered, along each document, whose blocks a file's bounds bound."""
    title = render.run_text(F.col("runs"))
    rows = blocks.where("pos IS NOT NULL").withColumn("text", title)
    rows = history.carry_page(history.carry_heading(rows, "doc_key", "pos"), "doc_key", "pos")
    piece = lambda text, of=None: F.struct(text.alias("text"), T.approx_tokens(text).alias("token_count"), T.terms(text if of is None else of).alias("terms"))
    fence = F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), F.col("code_text"), F.lit("\n```"))
    kind = F.col("kind")
    pieces = (
        F.when(kind == "heading", F.array(piece(F.concat(F.lit("# "), title))))
        .when(kind == "paragraph", F.transform(split_long(title, max_tokens, overlap), lambda p: piece(p)))
        .when(kind == "list", F.array(piece(render.block_text())))
        .when(kind == "code", F.array(piece(fence, F.col("code_text"))))
        .when(kind == "table", F.transform(render.table_parts(max_tokens), lambda p: F.struct(p["text"].alias("text"), p["token_count"].alias("token_count"), T.terms(p["text"]).alias("terms"))))
    )
    each = rows.select("doc_key", "pos", anchor().alias("anchor"), "nearest_heading", F.col("carried_page").alias("page"), F.posexplode(pieces).alias("part", "c"))
    order = Window.partitionBy("doc_key").orderBy("pos", "part")
    numbered = each.select("doc_key", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), "pos", "anchor", "nearest_heading", "page", "c.*")
    out = numbered.join(sources.select("doc_key", "digest", "display_name"), "doc_key")
    return out.withColumn("chunk_id", F.concat(F.substring("digest", 1, 8), F.lit(":c"), F.col("ordinal")))


def citation_label(chunk_id: Column, display_name: Column, heading: Column | None = None, page: Column | None = None) -> Column:
    parts = [F.concat(F.lit("[source: "), chunk_id), F.concat(F.lit('"'), display_name, F.lit('"'))]
    if heading is not None:
        parts.append(F.concat(F.lit("§ "), heading))
    if page is not None:
        parts.append(F.concat(F.lit("Page "), page))
    return F.concat(F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("]"))


def prompt_cost(token_count: Column, label: Column) -> Column:
    """Tokens that a chunk takes in a prompt: its own, its label's and ten for the markup."""
    return token_count + T.approx_tokens(label) + 10
