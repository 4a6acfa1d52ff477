"""Multipart form bodies as rows of parts, in Column expressions: bytes are held as characters of one byte each.

A body is split at every occurrence of its boundary. A part is what lies between two of them, less one line end on either
side; its headers end at the first empty line. Parts without an empty line, without a name or with headers that aren't
UTF-8 are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as T

ONE_BYTE = "ISO-8859-1"
#: The codes of requests that hold no parts.
NO_BOUNDARY, MALFORMED, NO_PARTS = "no_boundary", "malformed", "no_parts"


def boundary(content_type: Column) -> Column:
    """The boundary that a content type names, without quotes; null where it names none."""
    named = F.filter(F.transform(F.split(content_type, ";"), T.trim_space), lambda p: F.startswith(p, F.lit("boundary=")))
    value = lambda p: T.trim_space(F.substring(p, F.lit(10), F.length(p)))
    bare = F.transform(named, lambda p: F.regexp_replace(value(p), r'^"(.*)"$', "$1"))
    return F.get(F.filter(bare, lambda b: b != ""), F.lit(0))


def _quoted(x: Column) -> Column:
    """A pattern for exactly x."""
    return F.regexp_replace(x, r"([^A-Za-z0-9])", r"\\$1")


def _before(x: Column, mark: str) -> Column:
    """Where a mark begins in x, counted from 1; 0 where it doesn't occur."""
    return F.instr(x, F.lit(mark))


def _parameter(header: Column, name: str) -> Column:
    """The last parameter of that name in a header's value, without quotes."""
    found = F.filter(F.transform(F.split(header, ";"), T.trim_space), lambda p: F.startswith(p, F.lit(f"{name}=")))
    value = F.try_element_at(found, F.lit(-1))
    bare = T.trim_space(F.substring(value, F.lit(len(name) + 2), F.length(value)))
    return F.regexp_replace(bare, '^"+|"+$', "")


def _part(piece: Column) -> Column:
    """struct(head, data) of what lies between two boundaries; null without an empty line."""
    inner = F.regexp_replace(F.regexp_replace(piece, r"\A\r?\n", ""), r"\r?\n\z", "")
    crlf, lf = _before(inner, "\r\n\r\n"), _before(inner, "\n\n")
    at, width = F.when(crlf > 0, crlf).otherwise(lf), F.when(crlf > 0, 4).otherwise(2)
    head = F.substring(inner, F.lit(1), at - 1)
    return F.when(at > 0, F.struct(head.alias("head"), F.substring(inner, at + width, F.length(inner)).alias("data")))


def _header(lines: Column, name: str) -> Column:
    """The values of a header's lines, in order."""
    at = lambda x: _before(x, ":")
    mine = F.filter(lines, lambda x: (at(x) > 0) & (T.ascii_lower(T.trim_space(F.substring(x, F.lit(1), at(x) - 1))) == name))
    return F.transform(mine, lambda x: T.trim_space(F.substring(x, at(x) + 1, F.length(x))))


def parts(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """key, part (from 0), name, filename, content_type, data and error_code of requests (key, content_type, body).

    A request that gives no part has one row with nothing but its error_code. A part's content type is null where it
    names none; of repeated headers and parameters the last counts."""
    mark = F.decode(F.encode(F.concat(F.lit("--"), F.col("mark")), "UTF-8"), ONE_BYTE)
    rows = requests.select(key, boundary(F.col("content_type")).alias("mark"), F.decode("body", ONE_BYTE).alias("body"))
    rows = rows.select(key, "mark", F.split("body", _quoted(mark)).alias("pieces"))
    inside = F.filter(F.transform(F.slice("pieces", F.lit(2), F.greatest(F.size("pieces") - 2, F.lit(0))), _part), lambda p: p.isNotNull() & F.is_valid_utf8(F.encode(p["head"], ONE_BYTE).cast("string")))

    def described(p: Column) -> Column:
        lines = F.transform(T.lines(F.decode(F.encode(p["head"], ONE_BYTE), "UTF-8")), T.trim_space)
        placed, kinds = _header(lines, "content-disposition"), _header(lines, "content-type")
        joined = F.array_join(placed, ";")
        return F.struct(
            _parameter(joined, "name").alias("name"), _parameter(joined, "filename").alias("filename"),
            F.try_element_at(kinds, F.lit(-1)).alias("content_type"), F.encode(p["data"], ONE_BYTE).alias("data"),
        )

    named = F.filter(F.transform(inside, described), lambda d: d["name"].isNotNull())
    rows = rows.select(key, "mark", (F.size("pieces") < 3).alias("few"), named.alias("found"))
    error = F.when(F.col("mark").isNull(), NO_BOUNDARY).when(F.col("few") | F.col("few").isNull(), MALFORMED).when(F.size("found") == 0, NO_PARTS)
    rows = rows.select(key, error.alias("error_code"), F.when(error.isNull(), F.col("found")).alias("found"))
    out = rows.select(key, "error_code", F.posexplode_outer("found").alias("part", "p"))
    return out.select(key, "part", "p.name", "p.filename", "p.content_type", "p.data", "error_code")


def upload(parts_of: DataFrame, field: str = "file", key: str = "request_id") -> DataFrame:
    """The first part of each request that stands in a field: key, filename, content_type, data."""
    first = F.min_by(F.struct("filename", "content_type", "data"), "part").alias("p")
    return parts_of.where(F.col("name") == field).groupBy(key).agg(first).select(key, "p.*")
