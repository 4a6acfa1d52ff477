"""Finding files: hidden names, excluded folders, symbolic links, ignore rules and limits."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import formats

#: Folders that are never entered, and the limits of a workspace.
EXCLUDED = [".git", ".github", "target", "node_modules", "dist", "build", ".cache", "vendor", ".cargo", ".gemini", ".vscode", ".idea", "models"]
MAX_FILE, MAX_TOTAL, MAX_FILES = 50 << 20, 250 << 20, 10_000


def glob_pattern(rule: str) -> re.Pattern:
    """A rule's path pattern: * and ? within a name, ** across names."""
    parts = [".*" if p == "**" else "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in p) for p in rule.strip("/").split("/")]
    body = "/".join(parts).replace(".*/", "(?:.*/)?").replace("/.*", "(?:/.*)?")
    return re.compile(("" if "/" in rule.rstrip("/") else "(?:.*/)?") + body)


class Rule(NamedTuple):
    """A line of an ignore file. A rooted rule's pattern is for a whole path with a slash behind every name, any other's for a name."""

    pattern: re.Pattern
    keep: bool
    folders_only: bool
    rooted: bool

    def matches(self, inner: bytes, is_dir: bool) -> bool:
        if self.folders_only and not is_dir:
            return False
        if self.rooted:
            return self.pattern.fullmatch(inner + b"/") is not None
        names = inner.split(b"/")
        return any(self.pattern.fullmatch(n) for n in (names if is_dir else names[-1:]))


@lru_cache(maxsize=1000)
def parsed(line: str) -> Rule | None:
    """The rule that a line states, for bytes of names; null for comments and blank lines."""
    rule = line.strip()
    if not rule or rule.startswith("#"):
        return None
    keep = rule.startswith("!")
    rule = rule[keep:].strip()
    bare = rule.rstrip("/")
    name = lambda x: b"".join({42: b"[^/]*", 63: b"[^/]"}.get(c, re.escape(bytes([c]))) for c in x)
    parts = bare.removeprefix("/").encode().split(b"/")
    whole = b"".join(b"(?:[^/]*/)*" if p == b"**" else name(p) + b"/" for p in parts)
    rooted = "/" in bare
    return Rule(re.compile(whole if rooted else name(parts[0]), re.S), keep, rule.endswith("/"), rooted) if bare else None


def ignored(path: str, is_dir: bool, rules: list[tuple[str, list[str]]]) -> bool:
    """Whether ignore files, outermost first as (folder, lines), leave a path out: the innermost file with a rule that
    matches decides, by the last of these."""
    for folder, lines in reversed(rules):
        inner = path[len(folder) + 1 :] if folder else path
        said = [r for line in lines if (r := parsed(line)) and r.matches(inner.encode(), is_dir)]
        if said:
            return not said[-1].keep
    return False


def walk(root: str) -> dict:
    """Files under root in path order, with what was passed over. Links out of root, broken ones and those to folders are skipped."""
    real = os.path.realpath(root)
    found: list[dict] = []
    counts = {"ignored": 0, "symlinks": 0, "oversized": 0}

    def visit(folder: str, rules: list[tuple[str, list[str]]]) -> None:
        here = os.path.join(real, folder)
        mine = os.path.join(here, ".gitignore")
        if os.path.isfile(mine):
            with open(mine, encoding="utf-8", errors="replace") as f:
                rules = [*rules, (folder, f.read().splitlines())]
        for entry in sorted(os.scandir(here), key=lambda e: e.name):
            path = f"{folder}/{entry.name}".lstrip("/")
            if entry.name.startswith("."):
                continue
            if entry.is_symlink():
                target = os.path.realpath(entry.path)
                if not os.path.isfile(target) or os.path.commonpath([real, target]) != real:
                    counts["symlinks"] += 1
                    continue
            if entry.is_dir(follow_symlinks=False):
                if entry.name not in EXCLUDED:
                    if not ignored(path, True, rules):
                        visit(path, rules)
            elif ignored(path, False, rules):
                counts["ignored"] += 1
            elif os.path.splitext(entry.name)[1].lower().lstrip(".") in formats.EXTENSIONS:
                size = os.path.getsize(entry.path)
                counts["oversized"] += size > MAX_FILE
                if size <= MAX_FILE:
                    found.append({"path": path, "byte_size": size})

    visit("", [])
    found.sort(key=lambda f: f["path"].split("/"))
    if len(found) > MAX_FILES or sum(f["byte_size"] for f in found) > MAX_TOTAL:
        raise ValueError("the workspace passes its limits")
    return {"files": found, **counts}


def ignored_by(path: Column, lines: list[str]) -> Column:
    """Whether the lines of an ignore file at the root leave out the file at path, or a folder that it lies in."""

    def verdict(at: Column, is_dir: bool) -> Column:
        out = F.lit(False)
        for line in lines:  # the last that matches decides
            rule = line.strip()
            if not rule or rule.startswith("#"):
                continue
            keep, rule = rule.startswith("!"), rule.removeprefix("!")
            if is_dir or not rule.endswith("/"):
                out = F.when(at.rlike(f"^(?:{glob_pattern(rule).pattern})$"), F.lit(not keep)).otherwise(out)
        return out

    parts = F.split(path, "/")
    folders = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.exists(folders, lambda f: verdict(f, True)) | verdict(path, False)


def hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: F.startswith(p, F.lit(".")))


def excluded(path: Column) -> Column:
    parents = F.split(path, "/")
    return F.arrays_overlap(F.slice(parents, F.lit(1), F.greatest(F.size(parents) - 1, F.lit(0))), F.array(*(F.lit(x) for x in EXCLUDED)))


def usable(files: DataFrame) -> DataFrame:
    """files (path, byte_size) that are visible, of a known format and within the size limit, with their format."""
    rows = files.withColumn("format", formats.from_path(F.col("path")))
    return rows.where(~hidden(F.col("path")) & ~excluded(F.col("path")) & F.col("format").isNotNull() & (F.col("byte_size") <= MAX_FILE))


def within_limits(max_total: int = MAX_TOTAL, max_files: int = MAX_FILES) -> Column:
    """Whether the files of a row of report() stay within the limits of a workspace."""
    return (F.col("n_files") <= max_files) & (F.col("total_bytes") <= max_total)


def report(files: DataFrame) -> DataFrame:
    """One row: files, bytes and what was passed over for its size."""
    rows = files.withColumn("format", formats.from_path(F.col("path"))).where(~hidden(F.col("path")) & ~excluded(F.col("path")) & F.col("format").isNotNull())
    small = F.col("byte_size") <= MAX_FILE
    return rows.agg(F.count_if(small).alias("n_files"), F.coalesce(F.sum(F.when(small, F.col("byte_size"))), F.lit(0)).alias("total_bytes"), F.count_if(~small).alias("oversized"))
