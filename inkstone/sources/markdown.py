"""Markdown to blocks. Pure Python, applied by Spark to one document at a time."""

from __future__ import annotations

import re

#: What the line kinds look like, after trimming.
FENCE, HEADING = re.compile(r"(```|~~~)\s*(.*)"), re.compile(r"(#{1,6})\s+(\S.*)")
TABLE, RULE = re.compile(r"\|.*\||\|"), re.compile(r"[\s:|-]*")
ITEM = re.compile(r"[-*] |[0-9].*\. ")
MARKER = re.compile(r"(?:[-*]|[0-9]+\.) ")

STRONG, EMPHASIS = re.compile(r"\*\*(.*?)\*\*", re.S), re.compile(r"\*(.*?)\*", re.S)


def split_lines(text: str) -> list[str]:
    parts = [x.removesuffix("\r") for x in text.split("\n")]
    return parts[:-1] if parts[-1] == "" else parts


def _run(kind: str, text: str, url: str | None = None) -> dict:
    return {"kind": kind, "text": text, "url": url}


def inline_runs(text: str) -> list[dict]:
    """Links first, strong text in what is left, then emphasis."""

    def styled(part: str) -> list[dict]:
        out: list[dict] = []
        for k, piece in enumerate(STRONG.split(part)):
            if k % 2:
                out.append(_run("strong", piece))
                continue
            out += [_run("emphasis" if n % 2 else "text", x) for n, x in enumerate(EMPHASIS.split(piece)) if x or n % 2]
        return out

    found: list[dict] = []
    at = 0
    while (start := text.find("[", at)) >= 0 and (middle := text.find("](", start)) >= 0 and (end := text.find(")", middle)) >= 0:
        found += [*styled(text[at:start]), _run("link", text[start + 1 : middle], text[middle + 2 : end])]
        at = end + 1
    return found + styled(text[at:]) or [_run("text", text)]


def _kind(line: str) -> str:
    if not line:
        return "blank"
    if FENCE.match(line):
        return "code"
    if HEADING.fullmatch(line):
        return "heading"
    if TABLE.fullmatch(line):
        return "table"
    if ITEM.match(line) and (line[0] in "-*" or len(line) >= 3):
        return "list"
    return "paragraph"


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip("|").split("|")]


def _ends_paragraph(line: str) -> bool:
    """A tilde fence does not end a paragraph; any line that starts with a hash does."""
    return _kind(line) not in ("paragraph", "code") or line.startswith(("#", "```"))


def blocks(text: str) -> list[dict]:
    """The blocks of a document in order, each with its section and its first and last line, counted from 1."""
    lines = split_lines(text)
    bare = [x.strip() for x in lines]
    out: list[dict] = []
    section: str | None = None
    at = 0

    def extent(start: int, more) -> int:
        end = start + 1
        while end < len(lines) and more(bare[end]):
            end += 1
        return end

    while at < len(lines):
        line, kind = bare[at], _kind(bare[at])
        if kind == "blank":
            at += 1
            continue
        new: dict = {"kind": kind, "line_start": at + 1}
        if kind == "code":
            mark, language = FENCE.match(line).groups()
            end = extent(at, lambda x: not x.startswith(mark))
            new |= {"language": language.strip() or None, "code_text": "\n".join(lines[at + 1 : end])}
            end = min(end + 1, len(lines))
        elif kind == "heading":
            hashes, title = HEADING.fullmatch(line).groups()
            section, end = title.strip(), at + 1
            new |= {"level": len(hashes), "runs": inline_runs(section)}
        elif kind == "table":
            end = extent(at, lambda x: _kind(x) == "table")
            rows = [_cells(x) for x in bare[at:end] if not RULE.fullmatch(x)]
            new |= {"headers": rows[0] if rows else [], "rows": rows[1:]}
        elif kind == "list":
            end = extent(at, lambda x: _kind(x) == "list")
            new |= {"ordered": line[0].isdigit(), "items": [inline_runs(MARKER.sub("", x, count=1).strip()) for x in bare[at:end]]}
        else:  # its first line is always taken, so that a stray hash can't stop the reader
            end = extent(at, lambda x: not _ends_paragraph(x))
            new["runs"] = inline_runs(" ".join(bare[at:end]))
        out.append(new | {"section": section, "line_end": end})
        at = end
    return out
