"""Readers of single files: bytes to blocks. Pure Python with bounds on input, inflated size and text."""

from __future__ import annotations

import io
import itertools
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

from . import markdown, xml

MAX_INPUT, MAX_INFLATED, MAX_TEXT = 50 << 20, 100 << 20, 10 << 20


class ReadError(Exception):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def _paragraph(text: str, **more) -> dict:
    return {"kind": "paragraph", "runs": [{"kind": "text", "text": text, "url": None}], **more}


def _utf8(data: bytes) -> str:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        raise ReadError("invalid_encoding") from None
    if "\0" in text:
        raise ReadError("invalid_encoding")
    return text


def read_plain(data: bytes) -> list[dict]:
    out, line = [], 1
    for piece in _utf8(data).split("\n\n"):
        n = max(1, len(markdown.split_lines(piece)) if piece else 0)
        if text := piece.strip():
            out.append(_paragraph(text, line_start=line, line_end=line + n - 1))
        line += n + 1 if text else 2
    return out


def _part(data: bytes, name: str) -> Iterator[xml.Token]:
    """The tokens of a part of an office file."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if sum(i.file_size for i in z.infolist()) > MAX_INFLATED:
                raise ReadError("too_large")
            text = z.read(name).decode("utf-8-sig")
    except (zipfile.BadZipFile, KeyError, UnicodeDecodeError, zlib.error, EOFError, NotImplementedError):
        raise ReadError("corrupted") from None
    return xml.tokens(text)


def _has(data: bytes, name: str) -> bool:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return name in z.namelist()
    except zipfile.BadZipFile:
        return False


def _number(text: str | None, low: int, high: int) -> int:
    """A number of a file within bounds; what isn't a number counts as the lower one."""
    return min(high, max(low, int(text))) if re.fullmatch(r"\d{1,9}", text or "") else low


def heading_level(style: str) -> int | None:
    """Title is 1, Subtitle 2, HeadingN N between 1 and 6."""
    style = style.lower().replace(" ", "")
    if style in ("title", "subtitle"):
        return 1 if style == "title" else 2
    m = re.fullmatch(r"heading(\d+)", style)
    return min(6, max(1, int(m[1]))) if m else None


class _Table:
    """Rows as they close; the first that has cells is the header. A cell's paragraphs are joined by blanks."""

    def __init__(self):
        self.rows: list[list[str]] = []
        self.row: list[str] = []
        self.cell = ""

    def add(self, text: str) -> None:
        self.cell += " " * bool(self.cell and text) + text

    def end_cell(self) -> None:
        self.row.append(self.cell.strip())
        self.cell = ""

    def end_row(self) -> None:
        if self.row or self.rows:
            self.rows.append(self.row)
        self.row = []

    def block(self) -> list[dict]:
        return [{"kind": "table", "headers": self.rows[0], "rows": self.rows[1:]}] if self.rows else []


class _Bounded:
    """Runs of the open paragraph, and how much text a file has given so far."""

    def __init__(self):
        self.runs: list[dict] = []
        self.size = 0

    def add(self, kind: str, text: str) -> None:
        self.size += len(text)
        if self.size > MAX_TEXT:
            raise ReadError("too_large")
        if text:
            self.runs.append({"kind": kind, "text": text, "url": None})

    def text(self) -> str:
        return "".join(r["text"] for r in self.runs)

    def joined(self) -> list[dict]:
        """The runs with neighbours of one kind made one."""
        out: list[dict] = []
        for kind, some in itertools.groupby(self.runs, key=lambda r: r["kind"]):
            out.append({"kind": kind, "text": "".join(r["text"] for r in some), "url": None})
        return out


def read_docx(data: bytes) -> list[dict]:
    """Paragraphs, headings and tables as their end tags come; a paragraph that another one opens in gives way to it."""
    out: list[dict] = []
    held, table, style = _Bounded(), _Table(), ""
    inside: set[str] = set()  # of p's and r's properties, r, t, tbl, tc, and the marks b and i of the open run
    for kind, name, body, closed in _part(data, "word/document.xml"):
        if kind == xml.TEXT:
            if inside >= {"r", "t"}:
                held.add("strong" if "b" in inside else "emphasis" if "i" in inside else "text", name)
        elif kind == xml.START:
            if name == "p":
                held.runs, style = [], ""
            elif name == "pStyle" and "pPr" in inside:
                style = xml.attribute(body, "val") or ""
            elif name in ("b", "i"):
                inside |= {name} if "rPr" in inside else set()
            elif name in ("tab", "br") and "r" in inside:
                held.add("strong" if "b" in inside else "emphasis" if "i" in inside else "text", {"tab": "\t", "br": "\n"}[name])
            elif name in ("pPr", "r", "rPr", "t", "tbl", "tc"):
                if name == "r":
                    inside -= {"b", "i"}
                elif name == "tbl":
                    table = _Table()
                elif name == "tc":
                    table.cell = ""
                inside |= set() if closed else {name}
            elif name == "tr":
                table.row = []
        elif name == "p":
            level = heading_level(style)
            if "tc" in inside:
                table.add(held.text())
            elif held.runs:
                runs = held.joined()
                out.append({"kind": "heading", "level": level, "runs": runs} if level else {"kind": "paragraph", "runs": runs})
            held.runs = []
        elif name in ("pPr", "r", "rPr", "t", "tbl", "tc"):
            if name == "tc" and "tbl" in inside:
                table.end_cell()
            elif name == "tbl":
                out += table.block()
                table = _Table()
            inside.discard(name)
        elif name == "tr" and "tbl" in inside:
            table.end_row()
    return out


def read_odt(data: bytes) -> list[dict]:
    """Paragraphs, headings, lists and tables as their end tags come. The items of lists inside a list stay in its order."""
    out: list[dict] = []
    held, table, level = _Bounded(), _Table(), 1
    items: list[list[dict]] = []
    lists = 0
    inside: set[str] = set()  # of h, p, list-item, table-cell
    for kind, name, body, closed in _part(data, "content.xml"):
        if kind == xml.TEXT:
            if inside & {"h", "p"}:
                held.add("text", name)
        elif kind == xml.START:
            if name in ("h", "p"):
                held.runs, level = [], _number(xml.attribute(body, "outline-level"), 1, 6) if name == "h" else level
            elif name in ("s", "tab", "line-break") and inside & {"h", "p"}:
                held.add("text", {"tab": "\t", "line-break": "\n"}.get(name) or " " * _number(xml.attribute(body, "c"), 1, MAX_TEXT + 1))
            elif name == "list":
                lists += not closed
            elif name == "table":
                table = _Table()
            elif name == "table-row":
                table.row = []
            elif name == "table-cell":
                table.cell = ""
            if name in ("h", "p", "list-item", "table-cell") and not closed:
                inside.add(name)
        elif name in ("h", "p"):
            inside.discard(name)
            runs = held.joined()
            if "table-cell" in inside:
                table.add(held.text())
            elif lists and "list-item" in inside:
                items += [runs] if runs else []
            elif runs:
                out.append({"kind": "heading", "level": level, "runs": runs} if name == "h" else {"kind": "paragraph", "runs": runs})
            held.runs = []
        elif name == "list-item":
            inside -= {name} if lists < 2 else set()
        elif name == "list" and lists:
            lists -= 1
            if not lists and items:
                out.append({"kind": "list", "ordered": False, "items": items})
                items = []
        elif name == "table-cell":
            inside.discard(name)
            table.end_cell()
        elif name == "table-row":
            table.end_row()
        elif name == "table":
            out += table.block()
            table = _Table()
    return out


_rtf_token = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z'])|([{}])|([^\\{}\r\n]+)")
#: Groups that hold no text, and control words that stand for characters.
RTF_SILENT = frozenset("fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr themedata generator listtable listoverridetable".split())
RTF_CHARS = {"tab": "\t", "line": "\n", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}


def read_rtf(data: bytes) -> list[dict]:
    if not data.startswith(b"{\\rtf"):
        raise ReadError("signature_mismatch")
    out: list[dict] = []
    held: list[str] = []
    groups = [(False, 1)]  # whether a group is silent, and how many characters stand in for a coded one
    skip = at = 0
    chars = data.decode("cp1252", "replace")
    while m := _rtf_token.search(chars, at):
        word, number, code, sign, brace, plain = m.groups()
        at = m.end()
        silent, stand_ins = groups[-1]
        if brace:
            skip = 0
            groups.append(groups[-1]) if brace == "{" else len(groups) > 1 and groups.pop()
        elif word == "bin":
            at += max(0, int(number or 0))
        elif sign == "*" or word in RTF_SILENT:
            groups[-1] = (True, stand_ins)
        elif silent:
            continue
        elif word == "uc":
            groups[-1] = (silent, max(0, int(number or 1)))
        elif word in ("par", "sect", "page"):
            if text := "".join(held).strip():
                out.append(_paragraph(text))
            held, skip = [], 0
        elif word == "u" and number:
            held.append(chr(int(number) % 65536))
            skip = stand_ins
        else:
            text = RTF_CHARS[word] if word in RTF_CHARS else bytes.fromhex(code).decode("cp1252", "replace") if code else {"~": "\u00a0", "_": "-", "-": ""}.get(sign, sign) if sign else plain or ""
            held.append(text[skip:])
            skip = max(0, skip - len(text))
    if text := "".join(held).strip():
        out.append(_paragraph(text))
    joined = [b["runs"][0] for b in out]
    for run in joined:  # two code units above the basic plane make one character
        run["text"] = run["text"].encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return out


#: Fixed value: how far behind its name an information dictionary is looked for.
PDF_INFO = 1024
_pdf_token = re.compile(rb"[\x00\t\n\x0c\r ]+|%[^\r\n]*|<<|>>|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|[()<>\[\]{}]|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_pdf_mark = re.compile(rb"[()\\]")
_pdf_begin = re.compile(rb"(?<![^\x00\t\n\x0c\r </>])BT(?![^\x00\t\n\x0c\r </>(\[%])")
#: What a letter behind a backslash stands for in a string; a line end there stands for nothing.
PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b"", b"\n": b""}


def _pdf_literal(data: bytes, start: int) -> tuple[bytes, int]:
    """The bytes of the string that opens at start, and where it ends; one that never closes goes to the end."""
    out: list[bytes] = []
    depth, at = 0, start
    while m := _pdf_mark.search(data, at):
        out.append(data[at : m.start()])
        at, mark = m.end(), m[0]
        if mark == b"\\":
            x = data[at : at + 1]
            if x.isdigit() and x < b"8":
                n = next(k for k in (3, 2, 1) if data[at : at + k].isdigit() and max(data[at : at + k]) < 56)
                out.append(bytes([int(data[at : at + n], 8) & 255]))
                at += n
            else:
                at += 2 if data[at : at + 2] == b"\r\n" else 1
                out.append(b"" if x == b"\r" else PDF_ESCAPES.get(x, x))
        else:
            depth += 1 if mark == b"(" else -1
            if not depth:
                return b"".join(out), at
            out.append(mark if depth > 1 or mark == b")" else b"")
    return b"".join([*out, data[at:]]), len(data)


def _pdf_decoded(raw: bytes) -> str:
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def _pdf_block(body: bytes, at: int) -> tuple[str, int]:
    """The text that a text object shows, from behind its BT; operands wait for their operator. Where it ends."""
    out: list[str] = []
    shown, listed, open_list = b"", "", False
    while m := _pdf_token.match(body, at):
        at, token = m.end(), m[0]
        if token == b"(":
            shown, at = _pdf_literal(body, m.start())
        elif token == b"<":
            end = body.find(b">", at)
            digits = re.sub(rb"[^0-9a-fA-F]", b"", body[at : end if end >= 0 else len(body)])
            shown, at = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1 if end >= 0 else len(body)
        elif token == b"[":
            listed, open_list = "", True
        elif token == b"]":
            shown, open_list = b"", False
        elif token == b"ET":
            break
        else:
            if (token in (b"T*", b"Td", b"TD", b"'", b'"')) and out and not out[-1].endswith("\n"):
                out.append("\n")
            if token == b"TJ":
                out.append(listed)
            elif token in (b"Tj", b"'", b'"'):
                out.append(_pdf_decoded(shown))
            if token[:1].isalpha() or token in (b"T*", b"'", b'"'):
                shown, listed, open_list = b"", "", False
            continue
        if open_list and token in (b"(", b"<"):
            listed += _pdf_decoded(shown)
    return "".join(out).strip(), at


def _pdf_text(body: bytes) -> str:
    """The texts of a stream's text objects, blank lines between them."""
    out: list[str] = []
    at = 0
    while m := _pdf_begin.search(body, at):
        text, at = _pdf_block(body, m.end())
        out += [text] if text else []
    return "\n\n".join(out)


def _inflated(body: bytes, most: int) -> bytes:
    """A deflated stream, with or without its header; a broken one as far as it goes."""
    for window in (15, -15):
        inflater = zlib.decompressobj(window)
        try:
            return inflater.decompress(body, most)
        except zlib.error:
            continue
    return b""


def read_pdf(data: bytes) -> list[dict]:
    """The text of every stream, in one pass over the file. A stream that shows text is a page."""
    if not data.startswith(b"%PDF-"):
        raise ReadError("signature_mismatch")
    if b"/Encrypt" in data:
        raise ReadError("encrypted")
    out: list[dict] = []
    inflated = page = at = 0
    while (keyword := data.find(b"stream", at)) >= 0:
        head = data[max(at, data.rfind(b"obj", at, keyword)) : keyword]
        start = keyword + 6
        start += data[start : start + 1] == b"\r"
        start += data[start : start + 1] == b"\n"
        end = data.find(b"endstream", start)
        if end < 0:
            break
        body, at = data[start:end], end + 9
        if b"/FlateDecode" in head:
            body = _inflated(body, MAX_INFLATED - inflated + 1)
            inflated += len(body)
            if inflated > MAX_INFLATED:
                raise ReadError("too_large")
        if text := _pdf_text(body):
            page += 1
            out += [_paragraph(p, page=page) for x in text.split("\n\n") if (p := x.strip())]
    if not out:
        raise ReadError("scanned_pdf_no_text")
    return out


def read_doc(data: bytes) -> list[dict]:
    if not data.startswith(bytes.fromhex("D0CF11E0A1B11AE1")):
        raise ReadError("signature_mismatch")
    stream = _ole_stream(data, "WordDocument")
    if len(stream) < 32:
        raise ReadError("corrupted")
    if struct.unpack_from("<H", stream, 10)[0] & 0x0100:
        raise ReadError("encrypted")
    wide = re.findall(rb"(?:[\x20-\x7e\xa0-\xff\r\t]\x00){4,}", stream[32:])
    narrow = re.findall(rb"[\x20-\x7e\x80-\xff\r\t]{4,}", stream[32:])
    texts = [x.decode("utf-16-le") for x in wide] if sum(map(len, wide)) // 2 > sum(map(len, narrow)) else [x.decode("cp1252", "replace") for x in narrow]
    return [_paragraph(p.strip()) for t in texts for p in t.split("\r") if len(p.strip()) >= 4]


def _ole_stream(data: bytes, name: str) -> bytes:
    """The bytes of a stream of a compound file, by its sector chain."""
    try:
        size = 1 << struct.unpack_from("<H", data, 30)[0]
        sector = lambda n: data[(n + 1) * size : (n + 2) * size]
        fat = [x for n in struct.unpack_from("<109I", data, 76) if n < 0xFFFFFFFA for x in struct.unpack(f"<{size // 4}I", sector(n))]

        def chain(n: int) -> bytes:
            out, seen = [], set()
            while n < len(fat) and n not in seen:
                seen.add(n)
                out.append(sector(n))
                n = fat[n]
            return b"".join(out)

        folder = chain(struct.unpack_from("<I", data, 48)[0])
        for at in range(0, len(folder) - 127, 128):
            length = struct.unpack_from("<H", folder, at + 64)[0]
            if folder[at : at + max(0, length - 2)].decode("utf-16-le", "replace") == name:
                start, n = struct.unpack_from("<IQ", folder, at + 116)
                return chain(start)[: n or None]
    except (struct.error, ValueError):
        raise ReadError("corrupted") from None
    raise ReadError("corrupted")


def _named(data: bytes, part: str, names: dict[str, str]) -> dict[str, str]:
    """The trimmed texts right behind start tags, by what these stand for; later ones replace earlier ones."""
    found: dict[str, str] = {}
    at = None
    for kind, name, _, _ in _part(data, part):
        if kind != xml.TEXT:
            at = names.get(name) if kind == xml.START else None
        elif at and (value := name.strip()):
            found[at] = value
    return found


_rtf_info = re.compile(r"\{\\(title|author) ((?:[^\\{}]|\\[\\{}]|\\u-?\d+ ?\?)*)\}")


def metadata(fmt: str | None, data: bytes) -> dict[str, str]:
    """Title, author, created and modified, as far as a file has them."""
    if fmt == "docx" and _has(data, "docProps/core.xml"):
        return _named(data, "docProps/core.xml", {"title": "title", "creator": "author", "created": "created", "modified": "modified"})
    if fmt == "odt" and _has(data, "meta.xml"):
        return _named(data, "meta.xml", {"title": "title", "creator": "author", "date": "created"})
    if fmt == "rtf" and data.startswith(b"{\\rtf"):
        plain = lambda x: re.sub(r"\\u(-?\d+) ?\?", lambda m: chr(int(m[1]) % 65536), re.sub(r"\\([\\{}])", r"\1", x))
        whole = lambda x: x.encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()
        return {k: v for k, x in _rtf_info.findall(data.decode("cp1252", "replace")) if (v := whole(plain(x)))}
    if fmt == "pdf" and (at := data.find(b"/Info")) >= 0:
        near = data[at : at + PDF_INFO]
        found = {k: _pdf_decoded(_pdf_literal(near, opening)[0]).strip() for k, mark in (("title", b"/Title"), ("author", b"/Author")) if (place := near.find(mark)) >= 0 and (opening := near.find(b"(", place)) >= 0}
        return {k: v for k, v in found.items() if v}
    return {}


READERS = {"txt": read_plain, "md": lambda data: markdown.blocks(_utf8(data)), "docx": read_docx, "odt": read_odt, "rtf": read_rtf, "pdf": read_pdf, "doc": read_doc}


def _size(block: dict) -> int:
    """The characters of all that a block holds."""
    runs = [*(block.get("runs") or []), *(r for item in block.get("items") or [] for r in item)]
    cells = [*(block.get("headers") or []), *(c for row in block.get("rows") or [] for c in row)]
    return sum(len(r["text"]) for r in runs) + sum(map(len, cells)) + len(block.get("code_text") or "")


def read(fmt: str | None, data: bytes) -> list[dict]:
    """The blocks of a file, or a ReadError that says why there are none."""
    if fmt not in READERS:
        raise ReadError("unsupported_format")
    if not data:
        raise ReadError("empty_file")
    if len(data) > MAX_INPUT:
        raise ReadError("too_large")
    found = READERS[fmt](data)
    if sum(map(_size, found)) > MAX_TEXT:
        raise ReadError("too_large")
    return found
