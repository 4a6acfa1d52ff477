"""Counts over one whole text that the quality operators share."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np

_words = re.compile(r"[^ \t-\r]+").findall
_solid = re.compile(r"[^\W_]").search
SYMBOLS = "#*$%&|<>"
UPPER, LETTER, DIGIT, SPACE, MARK, OTHER = range(6)


class Counts(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    n_ended_lines: int
    n_distinct: int
    n_short: int
    n_upper: int
    n_letters: int
    n_digits: int
    n_marks: int
    n_bangs: int
    n_bars: int
    n_adjacent: int
    n_bare: int


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each character of the basic plane; characters beyond it count as letters."""
    by = {"Lu": UPPER, "Lt": UPPER, "Ll": LETTER, "Lm": LETTER, "Lo": LETTER, "Mn": LETTER, "Mc": LETTER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT, "Zs": SPACE, "Zl": SPACE, "Zp": SPACE, "Cc": SPACE}
    kinds = [by.get(c := unicodedata.category(chr(k)), MARK if c[0] in "PS" else OTHER) for k in range(0xFFFF)]
    return np.array([*kinds, LETTER], np.uint8)


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words that stand in a window of three words found twice or more."""
    if len(ids) < 4:
        return 0
    n = np.int64(n_distinct)
    two = ids[:-1] * n + ids[1:]
    if n_distinct > 2_000_000:
        _, two = np.unique(two, return_inverse=True)
    _, which, count = np.unique(two[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    again = count[which] > 1
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : k + len(again)] |= again
    return int(hit.sum())


def counts(text: str | None) -> Counts:
    """All counts of a text; of null as of the empty text."""
    text = text or ""
    words = _words(text)
    first: dict[str, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if _words(x)] if "\n" in text else [text] * bool(words)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_kinds()[np.minimum(chars, 0xFFFF)], minlength=6)
    return Counts(
        n_words=len(words),
        word_chars=sum(map(len, words)),
        n_symbols=sum(map(text.count, SYMBOLS)),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=repeated_words(ids, len(first)),
        n_lines=len(lines),
        n_ended_lines=sum(x.rstrip().endswith((".", "!", "?", "…", '"', "»", "”", ":", ";")) for x in lines),
        n_distinct=len(first),
        n_short=sum(len(w) <= 3 for w in words),
        n_upper=int(kinds[UPPER]),
        n_letters=int(kinds[UPPER] + kinds[LETTER]),
        n_digits=int(kinds[DIGIT]),
        n_marks=int(kinds[MARK]),
        n_bangs=text.count("!"),
        n_bars=text.count("|"),
        n_adjacent=int((ids[1:] == ids[:-1]).sum()) if len(ids) else 0,
        n_bare=int(np.bincount(ids, minlength=len(first))[[k for w, k in first.items() if _solid(w) is None]].sum()) if words else 0,
    )
