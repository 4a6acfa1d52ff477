"""Blocks back to text, as Column expressions over the block table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.lit(""))), "")


def run_markdown(runs: Column) -> Column:
    def one(r: Column) -> Column:
        text = r["text"]
        return F.when(r["kind"] == "strong", F.concat(F.lit("**"), text, F.lit("**"))).when(r["kind"] == "emphasis", F.concat(F.lit("*"), text, F.lit("*"))).when(r["kind"] == "link", F.concat(F.lit("["), text, F.lit("]("), r["url"], F.lit(")"))).otherwise(text)

    return F.array_join(F.transform(runs, one), "")


def _items(each) -> Column:
    numbered = F.transform("items", lambda x, i: F.concat(F.when(F.col("ordered"), F.concat((i + 1).cast("string"), F.lit(". "))).otherwise(F.lit("- ")), each(x)))
    return F.array_join(numbered, "\n")


def block_text(page_break: str | None = None) -> Column:
    """A block's plain text."""
    table = F.array_join(F.concat(F.when(F.size("headers") > 0, F.array(F.array_join("headers", " | "))).otherwise(F.array().cast("array<string>")), F.transform("rows", lambda r: F.array_join(r, " | "))), "\n")
    kind = F.col("kind")
    return (
        F.when(kind.isin("heading", "paragraph"), run_text(F.col("runs")))
        .when(kind == "list", _items(run_text))
        .when(kind == "table", F.rtrim(table))
        .when(kind == "code", F.col("code_text"))
        .when(kind == "page_break", F.concat(F.lit("[Page "), F.col("page"), F.lit("]")))
        .otherwise(F.concat(F.lit("[Unsupported: "), F.col("description"), F.lit("]")))
    )


def block_markdown() -> Column:
    """A block in Markdown."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size("headers")))
    table = F.concat(line(F.col("headers")), F.lit("\n"), rule, F.lit("\n"), F.array_join(F.transform("rows", line), "\n"))
    kind = F.col("kind")
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), run_markdown(F.col("runs"))))
        .when(kind == "paragraph", run_markdown(F.col("runs")))
        .when(kind == "list", _items(run_markdown))
        .when(kind == "table", table)
        .when(kind == "code", F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), F.col("code_text"), F.lit("\n```")))
        .when(kind == "page_break", F.lit("---"))
        .otherwise(F.concat(F.lit("<!-- Unsupported element: "), F.col("description"), F.lit(" -->")))
    )


def documents(blocks: DataFrame, text: Column) -> DataFrame:
    """doc_key, text: a document's blocks, put together with blank lines."""
    held = blocks.where("pos is not null").select("doc_key", "pos", text.alias("t"))
    return held.groupBy("doc_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda b: b["t"]), "\n\n").alias("text"))


def table_parts(max_tokens: int) -> Column:
    """A table as an array of (text, token_count): the whole if it fits, else runs of rows, each under the header."""
    from inkstone.functions.text import approx_tokens

    head = F.array_join("headers", " | ")
    whole = block_text()
    lines = F.transform("rows", lambda r: F.array_join(r, " | "))
    room = F.greatest(F.lit(1).cast("long"), max_tokens - approx_tokens(head))
    zero = F.from_json(F.lit('{"size": 0, "done": [], "rows": []}'), "struct<size: bigint, done: array<array<string>>, rows: array<string>>")

    def step(s: Column, row: Column) -> Column:
        n = approx_tokens(row)
        full = (s["size"] + n > room) & (F.size(s["rows"]) > 0)
        return F.struct(
            F.when(full, n).otherwise(s["size"] + n).alias("size"),
            F.when(full, F.concat(s["done"], F.array(s["rows"]))).otherwise(s["done"]).alias("done"),
            F.when(full, F.array(row)).otherwise(F.concat(s["rows"], F.array(row))).alias("rows"),
        )

    parts = F.aggregate(lines, zero, step, lambda s: F.when(F.size(s["rows"]) > 0, F.concat(s["done"], F.array(s["rows"]))).otherwise(s["done"]))
    with_head = F.transform(parts, lambda p: F.concat(head, F.lit("\n"), F.array_join(p, "\n"), F.lit("\n")))
    return F.when(approx_tokens(whole) <= max_tokens, F.array(F.struct(whole.alias("text"), approx_tokens(whole).alias("token_count")))).otherwise(F.transform(with_head, lambda t: F.struct(F.rtrim(F.regexp_replace(t, r"\s+$", "")).alias("text"), approx_tokens(t).alias("token_count"))))


def split_table(blocks: DataFrame, max_tokens: int) -> DataFrame:
    """Tables as chunks of rows under their header: doc_key, pos, part, text, token_count."""
    return blocks.where("kind = 'table'").select("doc_key", "pos", F.posexplode(table_parts(max_tokens)).alias("part", "c")).select("doc_key", "pos", F.col("part").cast("long").alias("part"), "c.text", "c.token_count")
