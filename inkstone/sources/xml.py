"""A tolerant scanner for the XML parts of office files: one pass, no tree, no error on tags that are never closed.

Comments, processing instructions and declarations are passed over, CDATA is text as it stands. Only the five named
entities and numeric references are decoded; a document type can define nothing. What begins a construct that has no end
ends the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

START, END, TEXT = "start", "end", "text"
#: The entities that XML defines.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_reference = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,9})|#([0-9]{1,9})|(amp|lt|gt|quot|apos));")


class Token(NamedTuple):
    kind: str
    name: str  # without its prefix; of a text the text
    body: str = ""  # what stands behind a start tag's name
    closed: bool = False


def _character(m: re.Match) -> str:
    if m[3]:
        return ENTITIES[m[3]]
    code = int(m[1], 16) if m[1] else int(m[2])
    return chr(code) if code < 0xD800 or 0xDFFF < code < 0x110000 else "�"


def decoded(text: str) -> str:
    return _reference.sub(_character, text) if "&" in text else text


def local(name: str) -> str:
    return name.rpartition(":")[2]


def attribute(body: str, name: str) -> str | None:
    """The value of an attribute, by its name without prefix; with or without quotes."""
    while True:
        key, sign, rest = body.partition("=")
        if not sign:
            return None
        rest = rest.lstrip()
        end = rest.find(rest[0], 1) if rest[:1] in ("'", '"') else -1
        if end > 0:
            value, body = rest[1:end], rest[end + 1 :]
        else:
            value = rest.split(maxsplit=1)[0] if rest else ""
            body = rest[len(value) :]
        if local((key.split() or [""])[-1]) == name:
            return decoded(value)


#: Openings of what is passed over or taken as it stands, and what ends it; the first that fits counts.
_SPECIAL = (("<!--", "-->"), ("<?", "?>"), ("<![CDATA[", "]]>"), ("<!", ">"))


def tokens(text: str) -> Iterator[Token]:
    at = 0
    while at < len(text):
        tag = text.find("<", at)
        if tag != at:
            end = len(text) if tag < 0 else tag
            yield Token(TEXT, decoded(text[at:end]))
            at = end
            continue
        opening, closing = next(((a, b) for a, b in _SPECIAL if text.startswith(a, at)), ("<", ">"))
        end = text.find(closing, at + len(opening))
        if end < 0:
            return
        inner = text[at + len(opening) : end]
        at = end + len(closing)
        if opening == "<![CDATA[":
            yield Token(TEXT, inner)
        elif opening == "<" and inner.startswith("/"):
            yield Token(END, local(inner[1:].strip()))
        elif opening == "<":
            inner = inner.strip()
            closed = inner.endswith("/")
            name, _, body = inner.removesuffix("/").strip().replace("\n", " ").replace("\t", " ").replace("\r", " ").partition(" ")
            yield Token(START, local(name), body, closed)
