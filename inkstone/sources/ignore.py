"""Ignore files as data: rules are compiled to patterns in their rows and meet the paths of their folders' trees in joins.

A rule file holds for everything in its folder. What counts is the innermost file with a rule that matches, in it the
last such rule; a folder that is left out takes all that lies in it along, whatever inner files say. Patterns are held
against the bytes of a name, so ? stands for one byte.

Folders are few where files are many, so everything that needs several steps is settled on folders: the rule files that
hold in one (its stack), and whether it or a folder above is left out. A file then meets one row of its folder and one
stack; both sides are unique by key, so a folder or stack with very many files can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as T


def parts_of(path: Column) -> Column:
    return F.split(path, "/")


def parent(path: Column) -> Column:
    """The folder that a path lies in, the empty text at the root."""
    parts = parts_of(path)
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")


def folders_above(folder: Column) -> Column:
    """The root and every folder on the way to a folder, itself included, outermost first."""
    parts = parts_of(folder)
    inner = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), inner))


def depth(folder: Column) -> Column:
    return F.when(folder == "", 0).otherwise(F.size(parts_of(folder)))


def bytes_as_characters(x: Column) -> Column:
    """A text whose characters are the bytes of x, so that patterns count bytes."""
    return F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")


def _name_pattern(part: Column) -> Column:
    quoted = F.regexp_replace(part, r"([\\.^$|()\[\]{}+])", r"\\$1")
    return F.replace(F.replace(quoted, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))


def rules(content: Column) -> Column:
    """An ignore file's rules in order: array<struct<pattern, keep, folders_only, rooted>>.

    The pattern of a rooted rule is for a whole path with a slash behind every name, of any other rule for one name."""

    def rule(line: Column) -> Column:
        keep = F.startswith(line, F.lit("!"))
        body = F.when(keep, T.trim_space(F.substring(line, F.lit(2), F.length(line)))).otherwise(line)
        bare = F.regexp_replace(body, "/+$", "")
        rooted = F.contains(bare, F.lit("/"))
        named = bytes_as_characters(F.regexp_replace(bare, "^/", ""))
        whole = F.array_join(F.transform(F.split(named, "/"), lambda p: F.when(p == "**", "(?:[^/]*/)*").otherwise(F.concat(_name_pattern(p), F.lit("/")))), "")
        pattern = F.concat(F.lit("^(?:"), F.when(rooted, whole).otherwise(_name_pattern(named)), F.lit(")$"))
        return F.struct(pattern.alias("pattern"), keep.alias("keep"), F.endswith(body, F.lit("/")).alias("folders_only"), rooted.alias("rooted"), (bare != "").alias("said"))

    lines = F.filter(F.transform(T.lines(content), T.trim_space), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    return F.transform(F.filter(F.transform(lines, rule), lambda r: r["said"]), lambda r: r.dropFields("said"))


def _matches(rule: Column, inner: Column, is_folder: bool) -> Column:
    """Whether a rule matches a path below its folder. Rules for one name look at all names of a folder's path, at a file's last."""
    names = parts_of(inner)
    named = F.exists(names, lambda n: F.rlike(n, rule["pattern"])) if is_folder else F.rlike(F.element_at(names, -1), rule["pattern"])
    found = F.when(rule["rooted"], F.rlike(F.concat(inner, F.lit("/")), rule["pattern"])).otherwise(named)
    return found if is_folder else found & ~rule["folders_only"]


def verdict(stack: Column, path: Column, is_folder: bool) -> Column:
    """Whether a stack (array<struct<folder, rules>>, innermost first) leaves a path out; false where no rule matches."""

    def of_file(held: Column) -> Column:
        inner = bytes_as_characters(F.when(held["folder"] == "", path).otherwise(F.substring(path, F.length(held["folder"]) + 2, F.length(path))))
        return ~F.try_element_at(F.filter(held["rules"], lambda r: _matches(r, inner, is_folder)), F.lit(-1))["keep"]

    decided = F.filter(F.transform(F.coalesce(stack, F.array().cast(STACK)), of_file), lambda d: d.isNotNull())
    return F.coalesce(F.get(decided, F.lit(0)), F.lit(False))


RULE = "struct<pattern: string, keep: boolean, folders_only: boolean, rooted: boolean>"
STACK = f"array<struct<folder: string, rules: array<{RULE}>>>"


def rule_stacks(rule_files: DataFrame) -> DataFrame:
    """owner, stack: for each folder with a rule file the rule files that hold in it, innermost first.

    rule_files: folder (the empty text at the root), content. Of several files for a folder the greatest content counts."""
    held = rule_files.groupBy("folder").agg(F.max("content").alias("content")).select("folder", rules(F.coalesce("content", F.lit(""))).alias("rules"))
    above = held.select(F.col("folder").alias("owner"), F.explode(folders_above(F.col("folder"))).alias("folder"))
    met = above.join(held, "folder").groupBy("owner").agg(F.sort_array(F.collect_list(F.struct(depth(F.col("folder")).alias("depth"), "folder", "rules")), asc=False).alias("s"))
    return met.select("owner", F.transform("s", lambda x: F.struct(x["folder"].alias("folder"), x["rules"].alias("rules"))).alias("stack"))


def judged_folders(folders: DataFrame, rule_files: DataFrame) -> DataFrame:
    """folder, owner (the folder whose stack holds in it, null without one) and left_out, of every folder on the way to folders."""
    tree = folders.select(F.explode(folders_above(F.col("folder"))).alias("folder")).distinct()
    own = rule_files.select(F.col("folder").alias("owner")).distinct()
    nearest = tree.select("folder", F.explode(folders_above(F.col("folder"))).alias("owner")).join(own, "owner")
    nearest = nearest.groupBy("folder").agg(F.max_by("owner", depth(F.col("owner"))).alias("owner"))
    owned = tree.join(nearest, "folder", "left")
    up = owned.where("folder <> ''").select("folder", parent(F.col("folder")).alias("up"))
    up = up.join(owned.select(F.col("folder").alias("up"), "owner"), "up").join(rule_stacks(rule_files), "owner", "left")
    out = up.where(verdict(F.col("stack"), F.col("folder"), True)).select(F.col("folder").alias("above"))
    gone = tree.select("folder", F.explode(folders_above(F.col("folder"))).alias("above")).join(out, "above").select("folder").distinct()
    return owned.join(gone.withColumn("left_out", F.lit(True)), "folder", "left").select("folder", "owner", F.coalesce("left_out", F.lit(False)).alias("left_out"))


def judged(files: DataFrame, rule_files: DataFrame) -> DataFrame:
    """files (path and more) with ignored_by: 'folder' where a folder above is left out, 'file' where a rule leaves out the
    file itself, else null. The first kind is never walked into, so only the second is counted as ignored."""
    rows = files.select(F.struct("*").alias("file"), parent(F.col("path")).alias("folder"))
    folders = judged_folders(rows.select("folder").distinct(), rule_files)
    met = rows.join(folders, "folder").join(rule_stacks(rule_files), "owner", "left")
    how = F.when(F.col("left_out"), "folder").when(verdict(F.col("stack"), F.col("file.path"), False), "file")
    return met.select("file.*", how.alias("ignored_by"))
