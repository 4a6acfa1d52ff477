"""Text functions as Column expressions. White space is Unicode White_Space; case folding is ASCII only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"\p{IsWhite_Space}"
NOT_TERM = r"[^\p{IsAlphabetic}\p{N}]"
#: Characters that one token stands for.
CHARS_PER_TOKEN = 4


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def approx_tokens(text: Column) -> Column:
    """A quarter of the code points, rounded up, at least one."""
    return approx_tokens_of(F.length(text))


def approx_tokens_of(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(chars / F.lit(float(CHARS_PER_TOKEN)))).cast("long")


def terms(text: Column) -> Column:
    """Index terms: letters and digits, ASCII lower case, at least two bytes; repeated terms stay."""
    return F.filter(F.split(ascii_lower(text), NOT_TERM), lambda t: F.octet_length(t) >= 2)


def counted(items: Column) -> Column:
    """An array's distinct strings in order with their counts: array<struct<term, tf>>. No shuffle, one sort of the array."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: ~F.get(s, i - 1).eqNullSafe(F.get(s, i - 2)))
        ends = lambda b: F.concat(F.slice(b, 2, F.size(b)), F.array(F.size(s) + 1))
        cut = lambda b: F.zip_with(b, ends(b), lambda i, j: F.struct(F.get(s, i - 1).alias("term"), (j - i).cast("long").alias("tf")))
        return F.flatten(F.transform(F.array(starts), cut))

    # one-element arrays name what is used more than once, so that it is computed once
    held = F.filter(F.array(F.sort_array(items)), lambda s: F.size(s) > 0)
    return F.flatten(F.transform(held, runs))


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    parts = F.transform(F.split(text, "\n"), lambda x: F.when(F.endswith(x, F.lit("\r")), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n\n"), trim_space), lambda p: p != "")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def contains_any(text: Column, keys: list[str]) -> Column:
    found = F.contains(text, F.lit(keys[0]))
    for key in keys[1:]:
        found = found | F.contains(text, F.lit(key))
    return found
