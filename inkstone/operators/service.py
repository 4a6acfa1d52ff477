"""What a document service checks and answers with: uploads, source records, name completion, write grants, export warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.sources import formats

#: The media types that go with each format; others and missing ones are judged by name and bytes alone.
MEDIA_TYPES = {
    "md": ["text/markdown", "text/x-markdown", "text/plain"],
    "txt": ["text/plain"],
    "pdf": ["application/pdf"],
    "docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"],
    "doc": ["application/msword"],
    "rtf": ["application/rtf", "text/rtf"],
    "odt": ["application/vnd.oasis.opendocument.text"],
}
UNJUDGED = ["", "application/octet-stream"]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def upload_error(filename: Column, content_type: Column, content: Column) -> Column:
    """Why an upload is refused: name, bytes or media type; null where it is taken. Only the short extensions are known."""
    ext = T.ascii_lower(F.regexp_extract(filename, r"\.([^./\\]*)$", 1))
    media = T.ascii_lower(T.trim_space(F.element_at(F.split(F.coalesce(content_type, F.lit("")), ";"), 1)))
    fits = F.lit(False)
    for fmt, kinds in MEDIA_TYPES.items():
        fits = fits | ((ext == fmt) & media.isin(kinds))
    wrong = formats.validation_error(content, ext)
    return (
        F.when(filename.isNull() | (T.trim_space(filename) == ""), "no_filename")
        .when(content.isNull() | (F.octet_length(content) == 0), "empty_file")
        .when(~ext.isin(list(MEDIA_TYPES)), "unsupported_format")
        .when(wrong.isin("signature_mismatch", "invalid_encoding"), wrong)
        .when(~media.isin(UNJUDGED) & ~fits, "media_type_mismatch")
    )


def source_record(chunk_id: Column, file: Column, heading: Column, page: Column) -> Column:
    """A chunk's source as JSON; missing heading and page are left out."""
    return F.to_json(F.struct(chunk_id.alias("id"), file.alias("file"), heading.alias("heading"), page.alias("page")))


def complete(names: DataFrame, typed: list[str]) -> DataFrame:
    """For each query typed, how many names match it and what all that match start with. names: name.

    A name matches when it starts with the query or, ASCII case apart, contains it. The queries are parameters, so each
    name is held against them in its own row, and only counts and ends are shuffled."""
    asked = F.array(*(F.lit(t) for t in typed))
    matches = F.filter(asked, lambda q: F.startswith(F.col("name"), q) | F.contains(T.ascii_lower(F.col("name")), T.ascii_lower(q)))
    ends = names.select("name", F.explode(matches).alias("query")).groupBy("query").agg(F.count("*").alias("n_matches"), F.min("name").alias("lo"), F.max("name").alias("hi"))
    same = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length("lo"), F.length("hi"))), lambda n: F.substring(F.col("lo"), F.lit(1), n) == F.substring(F.col("hi"), F.lit(1), n)))
    return ends.select("query", "n_matches", F.substring(F.col("lo"), F.lit(1), same).alias("common"))


def writable(files: DataFrame, grants: DataFrame) -> DataFrame:
    """Files whose root is granted; a grant holds for exactly its root, not for what lies in it."""
    return files.join(grants.select("root"), "root", "left_semi")


def human_bytes(n: Column) -> Column:
    """A byte count with the largest unit that it reaches."""
    sized = lambda power, digits, unit: F.concat(F.format_number(n / float(1024**power), digits), F.lit(f" {unit}"))
    shown = F.when(n >= 1024**3, sized(3, 2, "GiB")).when(n >= 1024**2, sized(2, 1, "MiB")).when(n >= 1024, sized(1, 1, "KiB")).otherwise(F.concat(n, F.lit(" bytes")))
    return F.replace(shown, F.lit(","), F.lit(""))


#: The fields that a chat request may have, and the roles of its messages.
REQUEST_FIELDS = ["model", "messages", "stream", "temperature", "top_p", "max_tokens", "stop"]
ROLES = ["system", "user", "assistant"]


def chat_request_error(body: Column) -> Column:
    """Why a chat request (a JSON text) is refused: invalid_request, unsupported_field or invalid_parameter with the
    parameter's name; null where it is taken. The first fault in the order of the checks counts."""
    v = F.try_parse_json(body)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    number = lambda path: F.coalesce(kind(path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit(False))
    held = lambda name: F.array_contains(keys, name)
    keys = F.json_object_keys(body)
    value = lambda path: F.try_variant_get(v, path, "double")
    messages = F.try_variant_get(v, "$.messages", "array<variant>")
    said = lambda m, path: F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(m, path, "variant")) == "STRING", F.try_variant_get(m, path, "string")), F.lit(""))
    bad = F.exists(messages, lambda m: (said(m, "$.role") == "") | (said(m, "$.content") == "") | ~said(m, "$.role").isin(ROLES))
    outside = lambda name, low, high: held(name) & ~(number(f"$.{name}") & F.coalesce(value(f"$.{name}").between(low, high), F.lit(False)))
    return (
        F.when(v.isNull() | ~F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)), "invalid_request")
        .when(F.exists(keys, lambda k: ~k.isin(REQUEST_FIELDS)), "unsupported_field")
        .when(outside("temperature", 0.0, 2.0), "invalid_parameter:temperature")
        .when(outside("top_p", 0.0, 1.0), "invalid_parameter:top_p")
        .when(held("max_tokens") & ~((kind("$.max_tokens") == "BIGINT") & (value("$.max_tokens") >= 1)), "invalid_parameter:max_tokens")
        .when(messages.isNull() | (F.size(messages) == 0) | bad, "invalid_parameter:messages")
    )


#: The fields of a settings file and of a remote profile in it, and their limits.
SETTINGS_FIELDS = ["schema_version", "preferred_local_profile", "write_workspaces", "remote_profiles"]
PROFILE_FIELDS = ["name", "base_url", "model", "credential"]
MAX_SETTINGS, MAX_WORKSPACES, MAX_PROFILES = 65_536, 256, 32


def settings_valid(body: Column) -> Column:
    """Whether a settings file (a JSON text) may be used: size, fields, version 1, absolute workspaces, and profiles with
    names of their own and the texts that they need. The form of their addresses is not judged."""
    v = F.try_parse_json(body)
    kind = lambda x, path: F.schema_of_variant(F.try_variant_get(x, path, "variant"))
    held = lambda name: F.coalesce(F.array_contains(F.json_object_keys(body), name), F.lit(False))
    spaces, profiles = F.try_variant_get(v, "$.write_workspaces", "array<variant>"), F.try_variant_get(v, "$.remote_profiles", "array<variant>")
    absolute = F.forall(spaces, lambda x: F.coalesce((F.schema_of_variant(x) == "STRING") & F.startswith(F.try_variant_get(x, "$", "string"), F.lit("/")), F.lit(False)))
    names = F.transform(profiles, lambda p: F.try_variant_get(p, "$.name", "string"))
    texts = lambda p: [kind(p, f"$.{f}") == "STRING" for f in ("name", "base_url", "model")]
    whole = F.forall(profiles, lambda p: F.coalesce(texts(p)[0] & texts(p)[1] & texts(p)[2] & (F.try_variant_get(p, "$.name", "string") != "") & (F.try_variant_get(p, "$.model", "string") != ""), F.lit(False)))
    known = F.forall(F.json_object_keys(body), lambda k: k.isin(SETTINGS_FIELDS))
    good = known & (kind(v, "$.schema_version") == "BIGINT") & (F.try_variant_get(v, "$.schema_version", "bigint") == 1)
    good &= ~held("write_workspaces") | F.coalesce((F.size(spaces) <= MAX_WORKSPACES) & absolute, F.lit(False))
    good &= ~held("remote_profiles") | F.coalesce((F.size(profiles) <= MAX_PROFILES) & whole & (F.size(F.array_distinct(names)) == F.size(names)), F.lit(False))
    return F.coalesce((F.octet_length(body) <= MAX_SETTINGS) & good, F.lit(False))


def export_warnings(blocks: DataFrame, group: str, position: str) -> DataFrame:
    """A warning for each block that an export can't show, in order."""
    lost = blocks.where("kind = 'unsupported'").groupBy(group).agg(F.sort_array(F.collect_list(F.struct(position, "description"))).alias("w"))
    return lost.select(group, F.transform("w", lambda x: F.concat(F.lit("not exported: "), x["description"])).alias("warnings"))
