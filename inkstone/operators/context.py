"""Choosing chunks under a token budget and putting prompts together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T

LITE, PRO = (8192, 1024), (16384, 2048)
#: The marks that fence document text in a prompt, and what stands for them inside document text.
DOC_START = "=== BEGIN UNTRUSTED DOCUMENT CONTENT ==="
DOC_END = "=== END UNTRUSTED DOCUMENT CONTENT ==="
ESCAPED_START = "[escaped-delimiter: begin-untrusted-content]"
ESCAPED_END = "[escaped-delimiter: end-untrusted-content]"


def sanitize(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(DOC_START), F.lit(ESCAPED_START)), F.lit(DOC_END), F.lit(ESCAPED_END))


def pack_prefix(rows: DataFrame, group: str, order: list[str], budget: int, keep_first: bool = False) -> DataFrame:
    """The longest prefix of each group whose cost fits; with keep_first the first row stays whatever it costs. rows: cost."""
    window = Window.partitionBy(group).orderBy(*order)
    running = F.sum("cost").over(window.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("running_cost", running)
    if keep_first:
        return out.withColumn("__n", F.row_number().over(window)).where((F.col("running_cost") <= budget) | (F.col("__n") == 1)).drop("__n")
    return out.where(F.col("running_cost") <= budget)


def _ordered(rows: DataFrame, group: str, item: Column) -> DataFrame:
    return rows.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("items"))


def batches(rows: DataFrame, group: str, budget: int) -> DataFrame:
    """Greedy batches: a row that would overflow a batch that has rows opens the next. rows: group, ordinal, cost.

    A batch depends on all rows before it, so each group is folded in order; groups are documents, which bounds them."""

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            numbers = []
            for items in table.column(1):
                batch = held = count = 0
                for cost in items.values.field("cost").to_pylist():
                    if count and held + cost > budget:
                        batch, held, count = batch + 1, 0, 0
                    held, count = held + cost, count + 1
                    numbers.append(batch)
            items = table.column(1)
            key = table.column(0).take(pc.list_parent_indices(items))
            ordinal, cost = (pc.list_flatten(items).field(k) for k in ("ordinal", "cost"))
            yield pa.RecordBatch.from_arrays([key, ordinal, cost, pa.array(numbers, pa.int64())], [group, "ordinal", "cost", "batch"])

    item = F.struct(F.col("ordinal").cast("long").alias("ordinal"), F.col("cost").cast("long").alias("cost"))
    return _ordered(rows, group, item).mapInArrow(work, f"{group} {rows.schema[group].dataType.simpleString()}, ordinal bigint, cost bigint, batch bigint")


def select_retrieval(hits: DataFrame, chunks: DataFrame, budget: int, window: int = 1) -> DataFrame:
    """For each query: ranked hits with their neighbours, taken in turn while they fit.

    A hit that was already taken as a neighbour is passed over with its own neighbours; a hit that overflows ends the
    query; a neighbour that overflows is passed over. hits: query_id, doc_key, ordinal, rank (20 at most for a query);
    chunks: doc_key, ordinal, chunk_id, cost. The fold sees at most 20 * (2 * window + 1) candidates of a query."""
    near = hits.select("query_id", "rank", "doc_key", F.col("ordinal").alias("hit"), F.explode(F.sequence(F.col("ordinal") - window, F.col("ordinal") + window)).alias("ordinal"))
    candidates = near.join(chunks.select("doc_key", "ordinal", "chunk_id", "cost"), ["doc_key", "ordinal"])
    item = F.struct("rank", (F.col("ordinal") != F.col("hit")).alias("beside"), "ordinal", "doc_key", "chunk_id", "cost")
    lists = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    taken = "array<struct<doc_key: bigint, ordinal: bigint, chunk_id: string, cost: bigint>>"
    zero = F.from_json(F.lit('{"stop": false, "active": false, "cost": 0, "out": []}'), f"struct<stop: boolean, active: boolean, cost: bigint, out: {taken}>")

    def step(s: Column, x: Column) -> Column:
        is_hit = ~x["beside"]
        seen = F.exists(s["out"], lambda o: (o["doc_key"] == x["doc_key"]) & (o["ordinal"] == x["ordinal"]))
        fits = s["cost"] + x["cost"] <= budget
        stop = s["stop"] | (is_hit & ~seen & ~fits)
        add = ~stop & ~seen & fits & (is_hit | s["active"])
        new = F.struct(x["doc_key"].alias("doc_key"), x["ordinal"].alias("ordinal"), x["chunk_id"].alias("chunk_id"), x["cost"].alias("cost"))
        return F.struct(
            stop.alias("stop"),
            F.when(is_hit, add).otherwise(s["active"]).alias("active"),
            F.when(add, s["cost"] + x["cost"]).otherwise(s["cost"]).alias("cost"),
            F.when(add, F.concat(s["out"], F.array(new))).otherwise(s["out"]).alias("out"),
        )

    return lists.select("query_id", F.inline(F.aggregate("items", zero, step, lambda s: s["out"])))


def reading_order(taken: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds read_at, each chunk's place when a query's chunks are read by file digest and ordinal. chunks: doc_key, ordinal, digest."""
    order = Window.partitionBy("query_id").orderBy("digest", "ordinal", "doc_key")
    placed = taken.join(chunks.select("doc_key", "ordinal", "digest"), ["doc_key", "ordinal"])
    return placed.withColumn("read_at", F.row_number().over(order).cast("long")).select(*taken.columns, "read_at")


def system_prompt(policy: Column, skills: Column, preferences: Column) -> Column:
    """The layers in front of the documents: the policy, each skill (an array of title and content) under its title, and
    the client's preferences, which stand last and only if there are any."""
    titled = F.transform(skills, lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n"), s["content"]))
    own = T.trim_space(F.coalesce(preferences, F.lit("")))
    last = F.when(own != "", F.array(F.concat(F.lit("## Client Preferences\n"), own))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(policy), titled, last), "\n\n")


def assemble(requests: DataFrame, chunks: DataFrame, system_tokens: int | Column, budget: tuple[int, int] = LITE) -> DataFrame:
    """User prompts. requests: request_id, query; chunks: request_id, position, chunk_id, label, text, cost.

    system_tokens: what the layers in front take, a number or a column of requests."""
    system = system_tokens if isinstance(system_tokens, Column) else F.lit(system_tokens)
    requests = requests.withColumn("system_tokens", system.cast("long"))
    room = F.greatest(F.lit(0), budget[0] - budget[1] - F.col("system_tokens") - T.approx_tokens(F.col("query")) - 50)
    window = Window.partitionBy("request_id").orderBy("position")
    offered = chunks.join(requests.select("request_id", room.alias("room")), "request_id")
    offered = offered.withColumn("n", F.row_number().over(window)).withColumn("run", F.sum("cost").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    kept = offered.where((F.col("run") <= F.col("room")) | (F.col("n") == 1))
    part = F.concat("label", F.lit("\n"), sanitize(F.col("text")), F.lit("\n\n"))
    held = kept.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("position", part.alias("part"), "chunk_id"))).alias("parts"))
    block = F.concat(F.lit(DOC_START + "\n"), F.array_join(F.transform("parts", lambda p: p["part"]), ""), F.lit(DOC_END + "\n\n"))
    out = requests.join(held, "request_id", "left")
    prompt = F.concat(F.when(F.col("parts").isNotNull(), block).otherwise(F.lit("")), F.col("query"))
    out = out.select("request_id", "system_tokens", prompt.alias("user_prompt"), F.coalesce(F.transform("parts", lambda p: p["chunk_id"]), F.array().cast("array<string>")).alias("included"))
    return out.withColumn("estimated_tokens", F.col("system_tokens") + T.approx_tokens(F.col("user_prompt"))).drop("system_tokens")
