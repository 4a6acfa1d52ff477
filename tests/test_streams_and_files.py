"""Nested ignore files, form bodies, byte-fragment streams, the growing index, tolerant readers, files read and written by tasks."""

import hashlib
import io
import itertools
import os
import random
import time
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstone.functions import tables
from inkstone.operators import bm25, chunking
from inkstone.sources import blocks as B
from inkstone.sources import discovery, guarded, ignore, markdown, multipart, readers, workspace, xml
from inkstone.streaming import answers, ingest

# ignore files


def glob(pattern: bytes, name: bytes) -> bool:
    if not pattern:
        return not name
    if pattern[:1] == b"*":
        return any(glob(pattern[1:], name[k:]) for k in range(len(name) + 1))
    return bool(name) and pattern[:1] in (b"?", name[:1]) and glob(pattern[1:], name[1:])


def parts_match(pattern, names):
    if not pattern:
        return not names
    if pattern[0] == b"**":
        return any(parts_match(pattern[1:], names[k:]) for k in range(len(names) + 1))
    return bool(names) and glob(pattern[0], names[0]) and parts_match(pattern[1:], names[1:])


def left_out(path, is_dir, files):
    """By walking up from the innermost folder, rule by rule."""
    names = path.split("/")
    for k in range(len(names) - 1, -1, -1):
        folder, inner = "/".join(names[:k]), [n.encode() for n in names[k:]]
        verdict = None
        for line in files.get(folder, "").split("\n"):
            rule = line.strip()
            if not rule or rule[0] == "#":
                continue
            keep = rule[0] == "!"
            rule = rule[keep:].strip()
            bare = rule.rstrip("/")
            if not bare or (rule.endswith("/") and not is_dir):
                continue
            pattern = [p.encode() for p in bare.removeprefix("/").split("/")]
            hit = parts_match(pattern, inner) if "/" in bare else any(glob(pattern[0], n) for n in (inner if is_dir else inner[-1:]))
            verdict = (not keep) if hit else verdict
        if verdict is not None:
            return verdict
    return False


def judged_by_hand(path, files):
    names = path.split("/")
    if any(left_out("/".join(names[:k]), True, files) for k in range(1, len(names))):
        return "folder"
    return "file" if left_out(path, False, files) else None


def test_nested_ignore_files_equal_a_walk(spark):
    rng = random.Random(4)
    names = ["a", "b", "ab", "out", "é", "x.md", "y.md", "xé.md", "a+b.md"]
    lines = ["a", "b/", "/a", "a/b", "*.md", "!x.md", "!a/", "?", "??", "**/b", "a/**", "/**/out", "!/b/x.md", "# a", " ! y.md ", "a*b.md", "x?.md", "x??.md", "!*", "/", "a//b", "*b*"]
    paths = sorted({"/".join(rng.choice(names[:5]) for _ in range(rng.randrange(4))) + "/" + rng.choice(names[5:]) for _ in range(150)})
    paths = [p.lstrip("/") for p in paths]
    folders = {"", *("/".join(p.split("/")[:k]) for p in paths for k in range(1, p.count("/") + 1))}
    seen = set()
    for _ in range(6):
        files = {f: "\n".join(rng.sample(lines, rng.randrange(1, 5))) for f in sorted(folders) if rng.random() < 0.3}
        rows = spark.createDataFrame([(p, 1) for p in paths], "path string, folder int")
        got = ignore.judged(rows, spark.createDataFrame(list(files.items()) or [("none", "")], "folder string, content string")).collect()
        assert {r.path: r.ignored_by for r in got} == {p: judged_by_hand(p, files) for p in paths} and len(got) == len(paths)
        for p in paths:
            stack = [("/".join(p.split("/")[:k]), files.get("/".join(p.split("/")[:k]), "").split("\n")) for k in range(p.count("/") + 1)]
            assert discovery.ignored(p, False, stack) == left_out(p, False, files)
        seen |= {r.ignored_by for r in got}
    assert seen == {"folder", "file", None}


def test_discovery_by_spark_equals_the_walk(spark, tmp_path):
    tree = {"a.md": "x", "sub/b.txt": "y", "sub/c.md": "z", "sub/deep/d.md": "w", "out/e.md": "v", "sub/out/f.md": "u", "g.bin": "t", ".h/i.md": "s", "build/j.md": "r", "sub/k.log.md": "q"}
    for name, text in {**tree, ".gitignore": "out/\n*.log.md\nc.md\n", "sub/.gitignore": "!out/\n!c.md\n*.txt\n", "sub/deep/.gitignore": "\xff"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="latin-1")
    root = str(tmp_path)
    files = workspace.listed(spark, root)
    found = workspace.discovered(files, workspace.rule_files(spark, root, files))
    walked = discovery.walk(root)
    read = workspace.read(spark, root, found).collect()
    assert sorted(r.path for r in read) == sorted(f["path"] for f in walked["files"]) == ["a.md", "sub/c.md", "sub/deep/d.md", "sub/out/f.md"]
    assert all(bytes(r.content).decode() == tree[r.path] and r.byte_size == 1 for r in read)
    assert tuple(workspace.report(found).first()) == (4, 4, 2, 0, True) and walked["ignored"] == 2
    assert [r.path for r in workspace.in_order(spark.createDataFrame([("a-b",), ("a/b",), ("a",)], "path string")).collect()] == ["a", "a/b", "a-b"]
    assert "ReadSchema: struct<path:string,length:bigint>" in files._jdf.queryExecution().executedPlan().toString()


# forms


def form_parts(spark, kind, body):
    rows = spark.createDataFrame([(1, kind, bytearray(body))], "request_id long, content_type string, body binary")
    return [(r.part, r.name, r.filename, r.content_type, None if r.data is None else bytes(r.data), r.error_code) for r in multipart.parts(rows).orderBy("part").collect()]


def test_form_parts(spark):
    kind = 'multipart/form-data; boundary="a.b*c"'
    body = b'junk\r\n--a.b*c\r\nContent-Disposition: form-data; name="f"; filename="x y.bin"\r\nContent-Type: a/b\r\n\r\n\x00\xff\r\n--a.b\r\n\r\n--a.b*c\nX: 1\ncontent-disposition:form-data;name=g\n\nlast\n\n--a.b*c--'
    assert form_parts(spark, kind, body) == [(0, "f", "x y.bin", "a/b", b"\x00\xff\r\n--a.b\r\n", None), (1, "g", None, None, b"last\n", None)]


@pytest.mark.parametrize(
    ("kind", "body", "code"),
    [
        ("multipart/form-data", b"--x\r\n\r\n--x--", "no_boundary"),
        (None, b"--x", "no_boundary"),
        ("multipart/form-data; boundary=", b"--x", "no_boundary"),
        ("multipart/form-data; boundary=x", b"", "malformed"),
        ("multipart/form-data; boundary=x", b"--x\r\nContent-Disposition: form-data; name=a\r\n\r\n", "malformed"),
        ("multipart/form-data; boundary=x", b"--x\r\nContent-Disposition: form-data\r\n\r\nno name\r\n--x--", "no_parts"),
        ("multipart/form-data; boundary=x", b"--x\r\nContent-Disposition: form-data; name=a\r\nno empty line\r\n--x--", "no_parts"),
        ("multipart/form-data; boundary=x", b'--x\r\nContent-Disposition: form-data; name="\xff"\r\n\r\nbad\r\n--x--', "no_parts"),
    ],
)
def test_bad_forms_are_error_rows(spark, kind, body, code):
    assert form_parts(spark, kind, body) == [(None, None, None, None, None, code)]


# event streams


def said(text):
    return b'data: {"choices":[{"delta":{"content":"' + text.encode() + b'"}}]}'


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=40))
def test_lines_don_t_depend_on_how_bytes_are_cut(cuts):
    body = "".join(f"data: {x}\r\n" for x in ("é", "𝔘n", "", "a\rb")).encode() + b"open"
    reader, got, at = answers.LineReader(), [], 0
    for n in itertools.chain(cuts, itertools.repeat(7)):
        got += reader.feed(body[at : at + n])
        at += n
        if at >= len(body):
            break
    assert got == [x.removesuffix(b"\r") for x in body.split(b"\n")[:-1]] and b"".join(reader.pieces) == b"open"


def test_event_line_contents():
    assert answers.contents(said("a")) == ["a"] and answers.contents(b"data: [DONE]") is None and answers.contents(b": note") == []
    assert answers.contents(b'data:{"choices":[{"delta":{}},{"delta":{"content":"x"}},{"delta":{"content":null}}]}') == ["x"]
    for bad in (b"data: x", b"data: {}", b"data:[DONE]", b'data: {"choices":[{}]}', b'data: {"choices":[{"delta":{"content":1}}]}', b"data: \xff", b'data: {"choices":[{"delta":{"content":"\\ud800"}}]}'):
        with pytest.raises(answers.Failure, match=answers.INVALID):
            answers.contents(bad)


def streamed(spark, tmp_path, batches, path=None):
    schema = "stream_id long, seq long, data binary"
    for rows in batches:
        spark.createDataFrame([(i, s, None if d is None else bytearray(d)) for i, s, d in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rows = answers.run_once(spark, answers.fragment_events(source), path or f"{tmp_path}/out").collect()
    return {i: [(r.n, r.kind, r.text) for r in sorted((r for r in rows if r.stream_id == i), key=lambda r: (r.n, r.kind != "token"))] for i in {r.stream_id for r in rows}}


def test_fragments_in_any_order_over_batches_and_restarts(spark, tmp_path):
    texts = ["Grü", "ße ", "𝔘nd", " so", " weiter"]
    body = b"\n".join([*map(said, texts), b"data: [DONE]"]) + b"\n"
    pieces = [body[k : k + 11] for k in range(0, len(body), 11)]
    rows = [(1, k, p) for k, p in enumerate(pieces)] + [(2, k, p) for k, p in enumerate(pieces[:9])] + [(2, 9, None)]
    rows += [(1, 3, pieces[3]), (1, 99, b"late"), (1, 5, pieces[5])]
    random.Random(1).shuffle(rows)
    half = len(rows) // 2
    first = streamed(spark, tmp_path, [rows[: half // 2], rows[half // 2 : half]])
    assert not any(kind == "finished" for events in first.values() for _, kind, _ in events)
    got = streamed(spark, tmp_path, [rows[half:-5], rows[-5:], rows])  # goes on from its checkpoint; the last batch repeats all
    known = [(k, "token", x) for k, x in enumerate(texts)]
    assert got[1] == [*known, (5, "finished", "".join(texts))]
    n = sum(1 for line in b"".join(pieces[:9]).split(b"\n")[:-1] if line)
    assert got[2] == [*known[:n], (n, "failed", "incomplete")]


def test_stream_bounds(spark, tmp_path, monkeypatch):
    big = said("y" * 200_000) + b"\n"
    batches = [[(1, k, big) for k in range(3)], [(1, k, big) for k in range(3, 7)], [(2, 0, b"x" * 262_145)], [(3, k, b":" + b"x" * 250_000 + b"\n") for k in range(20)], [(3, k, b":" + b"x" * 250_000 + b"\n") for k in range(20, 40)], [(4, 5, b"a" * 5_000_000), (4, 6, b"b" * 5_000_000)], [(5, 0, said("ok") + b"\n" + b"x" * 262_144 + b"\n" + b"data: [DONE]\n")]]
    got = streamed(spark, tmp_path, batches)
    assert [e[1:] for e in got[1]][-1] == ("failed", "response_limit") and len(got[1]) == 6
    assert got[2] == got[3] == got[4] == [(0, "failed", "response_limit")]
    assert got[5] == [(0, "token", "ok"), (1, "finished", "ok")]


def test_state_store_setting_comes_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), answers.state_store(spark):
        assert "RocksDB" in spark.conf.get(name)
        raise ZeroDivisionError
    assert spark.conf.get(name) == before


# the growing index


def test_index_of_batches_with_replays_equals_one_of_all(spark, sf_dir, tmp_path):
    chunks = tables.settle(chunking.chunk_plain_text(chunking.as_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))), "test-chunks")
    index = ingest.TermIndex(spark, f"{tmp_path}/index")
    assert index.search("en the", 5).collect() == [] and index.stats().first().n_chunks == 0
    part = lambda k: chunks.where(F.col("doc_key") % 3 == k)
    assert [index.add(part(k), k) for k in range(3)] == [True] * 3
    assert not index.add(part(1), 1)
    whole = [tuple(r) for r in bm25.search(chunks, "en the und", 10).collect()]
    assert [tuple(r) for r in index.search("en the und", 10).collect()] == whole
    import shutil

    shutil.rmtree(f"{tmp_path}/index/marks/batch=1")  # as if the batch had stopped before its mark
    assert index.batches() == [0, 2] and [tuple(r) for r in index.search("en the und", 10).collect()] == [tuple(r) for r in bm25.search(part(0).unionByName(part(2)), "en the und", 10).collect()]
    assert index.add(part(1), 1) and [tuple(r) for r in index.search("en the und", 10).collect()] == whole
    merged = index.merged(f"{tmp_path}/merged")
    assert merged.batches() == [0] and [tuple(r) for r in merged.search("en the und", 10).collect()] == whole
    assert "PushedFilters: [In(term" in index.search("en the und", 10)._jdf.queryExecution().toString()


# readers


def test_xml_tokens():
    text = "a&amp;&lt;&#65;&#x42;&#xD800;&nope;&<!-- <b> --><?p >?><!DOCTYPE x><w:t xml:space='preserve' w:val=\"a&quot;b\" n=5/>x<![CDATA[<&amp;>]]></w:t ><br/></none><open"
    got = list(xml.tokens(text))
    assert [(t.kind, t.name) for t in got] == [("text", "a&<AB�&nope;&"), ("start", "t"), ("text", "x"), ("text", "<&amp;>"), ("end", "t"), ("start", "br"), ("end", "none")]
    assert [xml.attribute(got[1].body, n) for n in ("space", "val", "n", "m")] == ["preserve", 'a"b', "5", None] and got[1].closed and got[5].closed


@pytest.mark.parametrize("part", ["<" * 200_000, "<a " * 60_000, "<!-- " * 60_000, "<a b='" * 60_000, "&" * 200_000, "<a>" * 60_000])
def test_xml_takes_linear_time(part):
    began = time.perf_counter()
    list(xml.tokens(part))
    assert time.perf_counter() - began < 2


def office(name, body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, body)
    return out.getvalue()


def shown(found):
    return [(b["kind"], "".join(r["text"] for r in b.get("runs") or []) or b.get("items") and [r[0]["text"] for r in b["items"]] or [b["headers"], *b["rows"]]) for b in found]


def test_docx_without_order():
    p = lambda x, more="": f"<w:p>{more}<w:r><w:t>{x}</w:t></w:r></w:p>"
    body = "<x></w:tbl></w:p>" + p("head", "<w:pPr><w:pStyle w:val='Heading2'>") + "<w:p><w:r><w:t>lost</w:t></w:r>" + p("kept") + "<w:tbl><w:tr></w:tr><w:tr><w:tc>" + p("a") + p("b") + "</w:tc><w:tc/></w:tr><w:tr><w:tc>" + p("c") + "</w:tc></w:tr></w:tbl><w:t>outside</w:t><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bo</w:t><w:t>ld</w:t></w:r><w:r><w:tab/><w:t>plain</w:t></w:r></w:p><w:p><w:r><w:t>cut"
    found = readers.read_docx(office("word/document.xml", body))
    assert shown(found) == [("heading", "head"), ("paragraph", "kept"), ("table", [["a b"], ["c"]]), ("paragraph", "bold\tplain")]
    assert [r["kind"] for r in found[3]["runs"]] == ["strong", "text"] and found[0]["level"] == 2


def test_odt_without_order():
    body = "<text:h outline-level='9'>h<text:s text:c='2'/>i</text:h></text:list><text:list><text:list-item><text:p>one</text:p><text:list><text:list-item><text:p>in</text:p></text:list-item></text:list></text:list-item><text:list-item><text:p>two</text:p></text:list></text:list-item><table:table><table:table-row><table:table-cell><text:p>a</text:p><text:p>b</text:p></table:table-cell></table:table-row></table:table><text:p>x<text:span>y</text:p><text:p>cut"
    assert shown(readers.read_odt(office("content.xml", body))) == [("heading", "h  i"), ("list", ["one", "in", "two"]), ("table", [["a b"]]), ("paragraph", "xy")]


def pdf(*streams):
    return b"%PDF-1.4\n" + b"".join(b"1 0 obj << /Length 0 " + head + b" >>\nstream\r\n" + body + b"\nendstream\n" for head, body in streams)


def test_pdf_operands_and_operators():
    body = rb"BT /F1 12 Tf (a \(b\) (c) \\ ET \101\12) Tj T* [(x) -20 <79> (z)] TJ 0 -1 Td <4142 4> Tj (new) ' 1 2 (far) " + b'" (lost) Tf [(no)] Tj ET (out) Tj BT (second) Tj ET BTx (no) Tj BT (open'
    found = readers.read_pdf(pdf((b"", body)))
    assert [b["runs"][0]["text"] for b in found] == ["a (b) (c) \\ ET A\nxyz\nAB@\nnew\nfar", "second"]
    assert {b["page"] for b in found} == {1}


def test_pdf_streams():
    text = b"BT (deep) Tj ET"
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    bare = raw.compress(text) + raw.flush()
    long_head = b"/Filter /FlateDecode " + b"/Pad (" + b"x" * 2000 + b")"
    found = readers.read_pdf(pdf((b"/Filter /FlateDecode", zlib.compress(text)), (b"/Filter /FlateDecode", bare), (b"", b"no text"), (long_head, zlib.compress(text)), (b"/Filter /FlateDecode", b"broken")))
    assert [(b["runs"][0]["text"], b["page"]) for b in found] == [("deep", 1), ("deep", 2), ("deep", 3)]
    assert readers.metadata("pdf", b"%PDF-1.4 trailer << /Info << /Title (A \\(t\\)) /Author <x> (Me) >> >>") == {"title": "A (t)", "author": "Me"}


def test_pdf_streams_beyond_the_bound_are_too_large(monkeypatch):
    monkeypatch.setattr(readers, "MAX_INFLATED", 1000)
    one = zlib.compress(b"BT (x) Tj ET" + b" " * 980)
    assert len(readers.read_pdf(pdf((b"/FlateDecode", one)))) == 1
    for streams in ([(b"/FlateDecode", zlib.compress(b"BT (x) Tj ET" + b" " * 990))], [(b"/FlateDecode", one)] * 2):
        with pytest.raises(readers.ReadError) as e:
            readers.read_pdf(pdf(*streams))
        assert e.value.code == "too_large"


@pytest.mark.parametrize("data", [b"<< /A 1 >> obj " * 600_000, b"1 0 obj <<>> stream\n" + b"BT " * 300_000, b"stream\nBT " + b"(" * 500_000 + b"endstream", b"stream\nBT " + b"[" * 300_000 + b"endstream", b"stream x endstream " * 100_000, b"stream\nBT " + b"<" * 100_000 + b"endstream"])
def test_pdf_takes_linear_time(data):
    began = time.perf_counter()
    with pytest.raises(readers.ReadError):
        readers.read_pdf(b"%PDF-" + data)
    assert time.perf_counter() - began < 3


def test_rtf_stand_ins_binary_and_late_titles():
    body = rb"{\rtf1\ansi{\fonttbl" + b"{\\f0 x;}" * 20_000 + rb"}{\info{\title Late}}\uc2\u8364 ab\uc0\u233 c{\uc1\u233 ?}d\bin3 {}}e\par}"
    assert readers.read_rtf(body)[0]["runs"][0]["text"] == "€écéde"
    assert readers.metadata("rtf", body) == {"title": "Late"}


@pytest.mark.parametrize("text", ["```\n{}\n```", "- {}\n", "| a |\n|---|\n| {} |\n", "{}"])
def test_the_text_bound_holds_for_every_kind_of_block(monkeypatch, text):
    monkeypatch.setattr(readers, "MAX_TEXT", 1000)
    assert readers.read("md", text.format("x" * 900).encode())
    with pytest.raises(readers.ReadError) as e:
        readers.read("md", text.format("x" * 1100).encode())
    assert e.value.code == "too_large"


def test_inline_runs_take_linear_time():
    began = time.perf_counter()
    for x in ("[" * 200_000, "[](" * 100_000, "**" * 100_000 + "*", "[a](b)" * 30_000):
        markdown.inline_runs(x)
    assert time.perf_counter() - began < 3


def test_reader_process_goes_on_after_timeouts_and_memory():
    reader = guarded.ReaderProcess()
    try:
        assert reader("read", "txt", b"a\n\nb")[1][1]["runs"][0]["text"] == "b"
        first = reader.child.pid
        reader.deadline = 0.05
        assert reader("read", "md", b"- x\n" * 2_000_000) == ("timeout", None)
        reader.deadline = 15
        assert reader("read", "txt", b"a")[0] is None and reader.child.pid != first
        bomb = office("word/document.xml", "<w:t>" + "x" * 90_000_000)
        reader.close()
        reader.memory = 64 << 20
        assert reader("read", "docx", bomb)[0] in ("out_of_memory", "corrupted")
        assert reader("read", "xlsx", b"a") == ("unsupported_format", None) and reader("read", "txt", b"\xff") == ("invalid_encoding", None)
        os.kill(reader.child.pid, 9)
        assert reader("read", "txt", b"a") == ("corrupted", None) and reader("read", "txt", b"a")[0] is None
    finally:
        reader.close()


def test_a_file_that_takes_too_long_is_one_error_row(spark):
    rows = spark.createDataFrame([(1, "md", bytearray(b"# ok")), (2, "md", bytearray(b"- x\n" * 2_000_000)), (3, "md", bytearray(b"fine"))], "doc_key long, format string, content binary").coalesce(1)
    got = B.read_blocks(rows, deadline=1.0).orderBy("doc_key").collect()
    assert [(r.doc_key, r.error_code) for r in got] == [(1, None), (2, "timeout"), (3, None)]


# files written by tasks


def test_files_are_written_whole_and_refused_where_they_must(spark, tmp_path):
    (tmp_path / "old.docx").write_bytes(b"old")
    (tmp_path / "old.md").write_bytes(b"old")
    (tmp_path / "away").symlink_to("/tmp")
    rows = [("a/b/c.md", b"new"), ("old.docx", b"new"), ("old.md", b"new"), ("../x.md", b"n"), ("/etc/x.md", b"n"), ("away/x.md", b"n"), ("twice.md", b"1"), ("twice.md", b"2"), (None, b"n"), ("empty.txt", None)]
    files = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")
    got = workspace.write(files, str(tmp_path)).collect()
    assert {r.path: r.error_code for r in got} == {"a/b/c.md": None, "old.docx": workspace.DENIED, "old.md": None, "../x.md": workspace.ESCAPES, "/etc/x.md": workspace.ESCAPES, "away/x.md": workspace.ESCAPES, "twice.md": workspace.REPEATED, None: workspace.ESCAPES, "empty.txt": None}
    assert len(got) == len(rows) and (tmp_path / "a/b/c.md").read_bytes() == (tmp_path / "old.md").read_bytes() == b"new" and (tmp_path / "old.docx").read_bytes() == b"old"
    assert {r.digest for r in got if r.path == "a/b/c.md"} == {hashlib.sha256(b"new").hexdigest()} and not (tmp_path / "twice.md").exists()
    workspace.write(files.where("path = 'old.docx'"), f"file:{tmp_path}", allow_overwrite=True)
    assert (tmp_path / "old.docx").read_bytes() == b"new"
    assert not [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".tmp")]


def test_a_retried_task_leaves_one_whole_file(spark, tmp_path):
    """Local masters don't retry, so the same write runs twice over what a killed attempt left."""
    (tmp_path / ".a.docx.7.tmp").write_bytes(b"ha")
    files = spark.createDataFrame([("a.docx", bytearray(b"half and half"))], "path string, content binary")
    for overwrite in (False, True):
        assert [r.error_code for r in workspace.write(files, str(tmp_path), overwrite).collect()] == [None]
    assert (tmp_path / "a.docx").read_bytes() == b"half and half"
    assert [r.path for r in workspace.listed(spark, str(tmp_path)).collect()] == ["a.docx"]
