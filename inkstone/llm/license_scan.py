"""License scans by ordered signature rules, in DataFrame operations only.

A text's words are lower-cased and set apart by single spaces. A short list of word parts gates the rules: most texts
hold none of them and are done. For the others, each rule's keyword decides whether its regular expression runs. Every
match is an interval of words with the rule's label and priority. A match that lies inside another of higher priority,
or of equal priority and greater length, is suppressed. The base phrases are found beside the rules and always stay.

Defined results: null and empty texts have no words, no labels, null first_word and last_word and score 0; texts of any
length are scanned whole; of detections of the same words and priority all stay; repeated rows give repeated results; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower
from .license_rules import gate, rules

#: What parts words, after lower-casing.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
DETECTION = "struct<label: string, priority: int, start: bigint, stop: bigint>"


def n_spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def padded_words(text: Column) -> Column:
    """All words, each between two single spaces; a single space for no words."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), BREAKS, " ")


def _first(words: Column, phrase: str) -> Column:
    at = F.instr(words, phrase)
    return F.when(at > 0, n_spaces(F.substring(words, F.lit(1), at - 1)))


def _last(words: Column, phrase: str) -> Column:
    at = F.instr(F.reverse(words), phrase[::-1])
    return F.when(at > 0, n_spaces(F.substring(words, F.lit(1), F.length(words) - at - len(phrase) + 1)))


def detections(words: Column) -> Column:
    """All matches of the rules whose keyword the words hold."""
    listed = json.dumps([r._replace(pattern=f" {r.pattern}(?= )")._asdict() for r in rules()])
    table = F.from_json(F.lit(listed), "array<struct<label: string, priority: int, keyword: string, pattern: string>>")

    def matches(rule: Column) -> Column:
        found = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
        gaps = F.split(words, rule["pattern"], -1)
        spans = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda x: F.struct(n_spaces(x["gap"]).alias("gap"), n_spaces(x["hit"]).alias("hit")))

        def place(so_far: Column, span: Column) -> Column:
            start = so_far["at"] + span["gap"]
            hit = F.struct(rule["label"].alias("label"), rule["priority"].alias("priority"), start.alias("start"), (start + span["hit"]).alias("stop"))
            return F.struct((start + F.coalesce(span["hit"], F.lit(0))).alias("at"), F.when(span["hit"].isNotNull(), F.concat(so_far["all"], F.array(hit))).otherwise(so_far["all"]).alias("all"))

        none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{DETECTION}>").alias("all"))
        return F.aggregate(spans, none, place, lambda s: s["all"])

    return F.flatten(F.transform(F.filter(table, lambda r: F.contains(words, r["keyword"])), matches))


def suppressed(found: Column) -> Column:
    """The detections that no stronger one contains.

    In the order of their starts, longer ones first, a detection is contained if the furthest end seen so far reaches its
    own; those ends are kept by priority, so each detection is looked at once.
    """
    order = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("back"), (-d["priority"]).alias("weight"), d["label"].alias("label"))))
    ends = F.array_repeat(F.lit(-1).cast("long"), 8)

    def look(seen: Column, d: Column) -> Column:
        stop, priority = -d["back"], -d["weight"]
        before = F.when((seen["start"] == d["start"]) & (seen["back"] == d["back"]), seen["before"]).otherwise(seen["ends"])
        contained = (F.get(seen["ends"], priority + 1) >= stop) | (F.get(before, priority) >= stop)
        reached = F.transform(seen["ends"], lambda end, k: F.when(k <= priority, F.greatest(end, stop)).otherwise(end))
        return F.struct(reached.alias("ends"), before.alias("before"), d["start"].alias("start"), d["back"].alias("back"), F.concat(seen["kept"], F.array(~contained)).alias("kept"))

    none = F.struct(ends.alias("ends"), ends.alias("before"), F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("back"), F.array().cast("array<boolean>").alias("kept"))
    kept = F.aggregate(order, none, look, lambda s: s["kept"])
    pairs = F.filter(F.arrays_zip(order.alias("d"), kept.alias("kept")), lambda x: x["kept"])
    return F.transform(pairs, lambda x: F.struct(x["d"]["label"].alias("label"), (-x["d"]["weight"]).alias("priority"), x["d"]["start"].alias("start"), (-x["d"]["back"]).alias("stop")))


def scan(docs: DataFrame) -> DataFrame:
    """The base figures, labels, score and detections of every row."""
    words = F.col("words")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), padded_words(F.col("text").cast("string")).alias("words"))
    gated = F.lit(False)
    for part in gate(tuple(p for p, _ in BASE)):
        gated = gated | F.contains(words, F.lit(part))
    held = held.withColumn("gated", gated)
    counted = [F.when(F.col("gated"), F.regexp_count(words, F.lit(f"(?= {p} )"))).otherwise(F.lit(0)).cast("long") for p, _ in BASE]
    firsts = [F.when(F.col("gated"), _first(words, f" {p} ")) for p, _ in BASE]
    lasts = [F.when(F.col("gated"), _last(words, f" {p} ")) for p, _ in BASE]
    held = held.select(
        "doc_id",
        F.greatest(n_spaces(words) - 1, F.lit(0)).cast("long").alias("n_words"),
        sum(counted[1:], counted[0]).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.sort_array(F.array_compact(F.array(*(F.when(f.isNotNull(), F.lit(label)) for f, (_, label) in zip(firsts, BASE, strict=True))))).alias("base"),
        F.when(F.col("gated"), detections(words)).otherwise(F.array().cast(f"array<{DETECTION}>")).alias("all"),
    )
    held = held.withColumn("found", suppressed(F.col("all")))
    best = F.coalesce(F.array_max(F.transform("found", lambda d: d["priority"])), F.lit(0))
    best = F.greatest(best, F.when(F.size("base") > 0, F.lit(2)).otherwise(F.lit(0)))
    labels = F.sort_array(F.array_distinct(F.concat(F.col("base"), F.transform("found", lambda d: d["label"]))))
    return held.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        (best / 5.0).cast("double").alias("score"),
        F.col("found").alias("detections"),
    )
