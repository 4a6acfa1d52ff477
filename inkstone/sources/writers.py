"""Writers of single files: blocks to bytes. Pure Python, applied by Spark to one document at a time."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from xml.sax.saxutils import escape, quoteattr

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
ODF = "urn:oasis:names:tc:opendocument:xmlns:"
DC = "http://purl.org/dc/elements/1.1/"
CREATOR = "inkstone"


def _text(runs: list[dict] | None) -> str:
    return "".join(r["text"] or "" for r in runs or [])


def _zip(parts: list[tuple[str, str]], stored: str | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body.encode(), zipfile.ZIP_STORED if name == stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _lines(block: dict) -> list[str]:
    """The paragraphs that stand for a block in formats without its kind."""
    kind = block["kind"]
    if kind == "list":
        return [(f"{i}. " if block.get("ordered") else "- ") + _text(x) for i, x in enumerate(block["items"], 1)]
    if kind == "table":
        return [" | ".join(r) for r in [block["headers"], *block["rows"]]]
    if kind == "code":
        return [block.get("code_text") or ""]
    if kind == "page_break":
        return [f"[Page {block.get('page')}]"]
    if kind == "unsupported":
        return [f"[Unsupported: {block.get('description')}]"]
    return [_text(block.get("runs"))]


def docx(blocks: list[dict], title: str | None = None) -> bytes:
    def run(text: str, mark: str = "") -> str:
        pieces = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in text.split("\n"))
        return f"<w:r>{mark and f'<w:rPr><w:{mark}/></w:rPr>'}{pieces}</w:r>"

    def paragraph(body: str, style: str = "") -> str:
        return f"<w:p>{style and f'<w:pPr><w:pStyle w:val={quoteattr(style)}/></w:pPr>'}{body}</w:p>"

    out = []
    for b in blocks:
        if b["kind"] in ("heading", "paragraph"):
            body = "".join(run(r["text"] or "", {"strong": "b", "emphasis": "i"}.get(r["kind"], "")) for r in b["runs"])
            out.append(paragraph(body, f"Heading{b['level']}" if b["kind"] == "heading" else ""))
        elif b["kind"] == "table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(run(c))}</w:tc>" for c in r) + "</w:tr>" for r in [b["headers"], *b["rows"]])
            out.append(f"<w:tbl>{rows}</w:tbl>")
        else:
            out += [paragraph(run(x)) for x in _lines(b)]
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    types = f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>'
    links = f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/><Relationship Id="r2" Type="http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>'
    core = f'{head}<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="{DC}"><dc:title>{escape(title or "")}</dc:title><dc:creator>{CREATOR}</dc:creator></cp:coreProperties>'
    return _zip([("[Content_Types].xml", types), ("_rels/.rels", links), ("docProps/core.xml", core), ("word/document.xml", f'{head}<w:document xmlns:w="{WORD}"><w:body>{"".join(out)}</w:body></w:document>')])


def odt(blocks: list[dict], title: str | None = None) -> bytes:
    def spaced(text: str) -> str:
        return escape(text).replace("\n", "<text:line-break/>").replace("\t", "<text:tab/>").replace("  ", ' <text:s text:c="1"/>')

    def marked(runs: list[dict]) -> str:
        style = {"strong": "Strong", "emphasis": "Emphasis"}
        return "".join(f'<text:span text:style-name="{style[r["kind"]]}">{spaced(r["text"] or "")}</text:span>' if r["kind"] in style else spaced(r["text"] or "") for r in runs)

    out = []
    for b in blocks:
        if b["kind"] == "paragraph":
            out.append(f"<text:p>{marked(b['runs'])}</text:p>")
        elif b["kind"] == "heading":
            out.append(f'<text:h text:outline-level="{b["level"]}">{spaced(_text(b["runs"]))}</text:h>')
        elif b["kind"] == "list":
            out.append("<text:list>" + "".join(f"<text:list-item><text:p>{spaced(_text(x))}</text:p></text:list-item>" for x in b["items"]) + "</text:list>")
        elif b["kind"] == "table":
            out.append("<table:table>" + "".join("<table:table-row>" + "".join(f"<table:table-cell><text:p>{spaced(c)}</text:p></table:table-cell>" for c in r) + "</table:table-row>" for r in [b["headers"], *b["rows"]]) + "</table:table>")
        else:
            out += [f"<text:p>{spaced(x)}</text:p>" for x in _lines(b)]
    kind = "application/vnd.oasis.opendocument.text"
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    styles = '<office:automatic-styles><style:style style:name="Strong" style:family="text"><style:text-properties fo:font-weight="bold"/></style:style><style:style style:name="Emphasis" style:family="text"><style:text-properties fo:font-style="italic"/></style:style></office:automatic-styles>'
    content = f'{head}<office:document-content xmlns:office="{ODF}office:1.0" xmlns:text="{ODF}text:1.0" xmlns:table="{ODF}table:1.0" xmlns:style="{ODF}style:1.0" xmlns:fo="{ODF}xsl-fo-compatible:1.0">{styles}<office:body><office:text>{"".join(out)}</office:text></office:body></office:document-content>'
    manifest = f'{head}<manifest:manifest xmlns:manifest="{ODF}manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{kind}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/><manifest:file-entry manifest:full-path="meta.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    meta = f'{head}<office:document-meta xmlns:office="{ODF}office:1.0" xmlns:dc="{DC}"><office:meta><dc:title>{escape(title or "")}</dc:title><dc:creator>{CREATOR}</dc:creator></office:meta></office:document-meta>'
    return _zip([("mimetype", kind), ("META-INF/manifest.xml", manifest), ("content.xml", content), ("meta.xml", meta)], stored="mimetype")


def rtf(blocks: list[dict], title: str | None = None) -> bytes:
    def plain(text: str) -> str:
        out = []
        for c in text:
            if c in "\\{}":
                out.append("\\" + c)
            elif c == "\n":
                out.append("\\line ")
            elif c == "\t":
                out.append("\\tab ")
            elif " " <= c <= "~":
                out.append(c)
            else:
                units = c.encode("utf-16-le")
                out += [f"\\u{int.from_bytes(units[i : i + 2], 'little', signed=True)}?" for i in range(0, len(units), 2)]
        return "".join(out)

    def marked(runs: list[dict]) -> str:
        return "".join({"strong": "{{\\b {}}}", "emphasis": "{{\\i {}}}"}.get(r["kind"], "{}").format(plain(r["text"] or "")) for r in runs)

    def shown(b: dict) -> list[str]:
        """A block's paragraphs; a heading is bold and the larger the higher its level."""
        if b["kind"] == "heading":
            return [f"{{\\b\\fs{44 - 4 * b['level']} {plain(_text(b['runs']))}}}"]
        return [marked(b["runs"])] if b["kind"] == "paragraph" else [plain(x) for x in _lines(b)]

    body = "".join(f"{x}\\par\n" for b in blocks for x in shown(b))
    info = f"{{\\info{{\\title {plain(title or '')}}}{{\\author {CREATOR}}}}}"
    return f"{{\\rtf1\\ansi\\deff0{{\\fonttbl{{\\f0 Times;}}}}\n{info}\n{body}}}".encode("ascii")


WRITERS = {"docx": docx, "odt": odt, "rtf": rtf}


def atomic_write(path: str, data: bytes) -> None:
    """Writes beside the target and renames, so that readers see the old file or the new one."""
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise
