"""Checking what a model wrote: citations, facts, gates and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as T

TAG = r"\[source:([^\]]*)\]"


def cited_ids(text: Column) -> Column:
    """The ids of all closed [source: …] tags, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), lambda x: T.trim_space(F.element_at(F.split(x, ","), 1)))


def check_citations(rows: DataFrame) -> DataFrame:
    """rows: key, text, valid_ids. Adds verified, unverified, total, valid_ratio and the rewritten text."""
    ids = rows.withColumn("cited", cited_ids(F.col("text")))
    ids = ids.withColumn("verified", F.filter("cited", lambda c: F.array_contains("valid_ids", c))).withColumn("unverified", F.filter("cited", lambda c: ~F.array_contains("valid_ids", c)))
    tags = F.regexp_extract_all(F.col("text"), F.lit(TAG), F.lit(0))

    def rewrite(text: Column, tag: Column) -> Column:
        own = T.trim_space(F.element_at(F.split(F.regexp_extract(tag, TAG, 1), ","), 1))
        return F.when(F.array_contains("valid_ids", own), text).otherwise(F.replace(text, tag, F.concat(F.lit("[unverified source: "), own, F.lit("]"))))

    total = F.size("cited").cast("long")
    ids = ids.withColumn("total", total).withColumn("valid_ratio", F.when(total == 0, 1.0).otherwise(F.size("verified") / total))
    return ids.withColumn("cleaned", F.aggregate(F.array_distinct(tags), F.col("text"), rewrite))


def match_facts(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """expected: item_id, key, expected; extracted: item_id, key, value. One row per expected fact, with matched."""
    clean = lambda c: T.ascii_lower(T.trim_space(F.col(c)))
    both = expected.join(extracted, ["item_id", "key"], "left")
    hit = F.coalesce((clean("value") == clean("expected")) | F.contains(clean("value"), clean("expected")), F.lit(False))
    return both.withColumn("matched", hit)


def invented_facts(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    return extracted.join(expected, ["item_id", "key"], "left_anti")


#: Fixed values: (least accuracy, least citation rate, most invented values, least context tokens, most bytes of memory).
GATES = {"lite": (0.85, 0.95, 0, 8192, 5_905_580_032), "pro": (0.92, 0.97, 0, 16384, 12_348_030_976)}


def tallies(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """item_id, matched_facts, missing_facts, invented_values, is_perfect of every item with an expected or invented fact."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    known = match_facts(expected, extracted).select("item_id", F.when(F.col("matched"), one).otherwise(none).alias("m"), F.when(F.col("matched"), none).otherwise(one).alias("x"), none.alias("i"))
    rest = invented_facts(expected, extracted).select("item_id", none.alias("m"), none.alias("x"), one.alias("i"))
    sums = known.unionByName(rest).groupBy("item_id").agg(F.sum("m").alias("matched_facts"), F.sum("x").alias("missing_facts"), F.sum("i").alias("invented_values"))
    return sums.withColumn("is_perfect", (F.col("missing_facts") == 0) & (F.col("invented_values") == 0))


def gate_failures(profile: str) -> Column:
    """Names of the requirements that a row of metrics misses."""
    accuracy, rate, invented, context, memory = GATES[profile]
    checks = [
        (F.col("factual_qa_accuracy") < accuracy, "factual_qa_accuracy"),
        (F.col("valid_citation_rate") < rate, "valid_citation_rate"),
        (F.col("invented_numeric") + F.col("invented_date") > invented, "invented_values"),
        (F.col("peak_rss_bytes") > memory, "peak_rss_bytes"),
        (F.col("active_context_tokens") < context, "active_context_tokens"),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in checks)))


def positional_diff(original: Column, proposed: Column) -> Column:
    """Pairs of lines by position: struct(op, line) in order, - before + where they differ."""
    pairs = F.arrays_zip(T.lines(original).alias("a"), T.lines(proposed).alias("b"))
    mark = lambda op, line: F.struct(F.lit(op).alias("op"), line.alias("line"))
    def both(x: Column) -> Column:
        changed = F.array_compact(F.array(F.when(x["a"].isNotNull(), mark("-", x["a"])), F.when(x["b"].isNotNull(), mark("+", x["b"]))))
        return F.when(x["a"] == x["b"], F.array(mark(" ", x["a"]))).otherwise(changed)

    return F.flatten(F.transform(pairs, both))


def diff_text(path: Column, original: Column, proposed: Column) -> Column:
    """A unified diff of one hunk over the whole file."""
    head = F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,"), F.size(T.lines(original)), F.lit(" +1,"), F.size(T.lines(proposed)), F.lit(" @@"))
    body = F.transform(positional_diff(original, proposed), lambda x: F.concat(F.lit("\n"), x["op"], x["line"]))
    return F.concat(head, F.array_join(body, ""))


#: Words of a request, English and Indonesian, that call for a skill.
SKILL_WORDS = {
    "safe-editing": ["edit", "modify", "replace", "update", "patch", "ubah", "ganti", "perbaiki"],
    "discovery": ["find", "discover", "list file", "list doc", "search doc", "workspace file", "workspace doc", "show doc", "show file", "cari berkas", "daftar dokumen", "cari dokumen"],
    "comparison": ["compare", "comparison", "contrast", "difference", "versus", " vs ", "bandingkan", "perbandingan", "beda", "perbedaan"],
    "summarization": ["summarize", "summary", "summaries", "overview", "synopsis", "tl;dr", "tldr", "ringkas", "ringkasan", "ikhtisar", "rangkum"],
}


def select_skills(query: Column, has_documents: Column, is_edit: Column) -> Column:
    """Ordered skill names for a request."""
    q = T.ascii_lower(query)
    edit, find, compare, summarize = (T.contains_any(q, w) for w in SKILL_WORDS.values())
    either = compare | summarize
    picks = [(edit | is_edit, "safe-editing"), (find, "discovery"), (compare, "comparison"), (summarize, "summarization"), (has_documents & ~either, "grounded-reading"), (has_documents | either, "citation")]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in picks)))
