"""Document formats: names, capabilities, signatures, validation, and the plain-text reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text as T

#: Extension and format.
EXTENSIONS = {"md": "md", "markdown": "md", "txt": "txt", "text": "txt", "pdf": "pdf", "docx": "docx", "doc": "doc", "rtf": "rtf", "odt": "odt"}
EDITABLE, EXPORTABLE, LEGACY = ["md", "txt"], ["md", "txt", "docx", "rtf", "odt"], ["doc"]
#: First bytes of each binary format, in hex.
SIGNATURES = {"pdf": "255044462D", "rtf": "7B5C727466", "doc": "D0CF11E0A1B11AE1", "zip": "504B0304"}
SAMPLE_EXTENSIONS = [".md", ".TXT", ".pdf", ".Docx", ".html", ".odt"]
SAMPLE_HEADS = ["255044462D", "7B5C727466", "D0CF11E0A1B11AE1", "504B0304", "504B03046D696D6574797065", ""]


def from_path(path: Column) -> Column:
    """The format of a file name; null for others."""
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.try_element_at(known, T.ascii_lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))


def is_editable(fmt: Column) -> Column:
    return fmt.isin(EDITABLE)


def is_exportable(fmt: Column) -> Column:
    return fmt.isin(EXPORTABLE)


def is_legacy(fmt: Column) -> Column:
    return fmt.isin(LEGACY)


def _starts(content: Column, kind: str) -> Column:
    sign = SIGNATURES[kind]
    return F.hex(F.substring(content, 1, len(sign) // 2)) == sign


def sniff(content: Column) -> Column:
    """The format that the first bytes tell; a ZIP file that names its type is OpenDocument, another one Word."""
    names_type = F.instr(F.decode(content, "ISO-8859-1"), F.lit("mimetype")) > 0
    return F.when(_starts(content, "pdf"), "pdf").when(_starts(content, "rtf"), "rtf").when(_starts(content, "doc"), "doc").when(_starts(content, "zip") & names_type, "odt").when(_starts(content, "zip"), "docx")


def validation_error(content: Column, fmt: Column) -> Column:
    """Why a file can't be what its format says; null where it can."""
    seen = F.decode(content, "ISO-8859-1")
    right = F.when(fmt == "pdf", _starts(content, "pdf")).when(fmt == "rtf", _starts(content, "rtf")).when(fmt == "doc", _starts(content, "doc")).when(fmt.isin("docx", "odt"), _starts(content, "zip")).otherwise(F.lit(True))
    text = fmt.isin("md", "txt")
    bad_text = F.contains(seen, F.lit("\0")) | ~F.is_valid_utf8(content.cast("string"))
    return (
        F.when(F.octet_length(content) == 0, "empty_file")
        .when(~right, "signature_mismatch")
        .when((fmt == "pdf") & F.contains(seen, F.lit("/Encrypt")), "encrypted")
        .when(text & bad_text, "invalid_encoding")
    )


def plain_text_blocks(files: DataFrame) -> DataFrame:
    """Paragraphs between blank lines with their line ranges: the columns of files but text, then pos, text, line_start, line_end."""
    keep = [c for c in files.columns if c != "text"]
    zero = F.from_json(F.lit('{"line": 1, "out": []}'), "struct<line: bigint, out: array<struct<text: string, line_start: bigint, line_end: bigint>>>")

    def step(s: Column, piece: Column) -> Column:
        text = T.trim_space(piece)
        n = F.greatest(F.lit(1), F.size(T.lines(piece))).cast("long")
        block = F.struct(text.alias("text"), s["line"].alias("line_start"), (s["line"] + n - 1).alias("line_end"))
        return F.struct((s["line"] + F.when(text == "", F.lit(2).cast("long")).otherwise(n + 1)).alias("line"), F.when(text == "", s["out"]).otherwise(F.concat(s["out"], F.array(block))).alias("out"))

    blocks = F.aggregate(F.split("text", "\n\n"), zero, step, lambda s: s["out"])
    return files.select(*keep, F.posexplode(blocks).alias("pos", "b")).select(*keep, F.col("pos").cast("long").alias("pos"), "b.*")
