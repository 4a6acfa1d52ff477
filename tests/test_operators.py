"""Operators on small cases, many of them with a plain Python version beside them."""

import math

import pytest
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import bm25, chunking, context, grounding, history, render, service
from inkstone.sources import blocks as B
from inkstone.sources import discovery, formats, markdown, readers, writers

CHUNK = "doc_key long, ordinal long, chunk_id string, display_name string, digest string, token_count long, text string, terms array<string>"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def files(spark, *texts):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    return chunking.as_files(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))


def test_terms_keep_bytes_and_fold_ascii_only(spark):
    assert value(spark, T.terms(F.lit("Ab É é b 12 x_y É"))) == ["ab", "É", "é", "12", "É"]


def test_tokens_words_and_lines(spark):
    assert value(spark, T.approx_tokens(F.lit(""))) == 1
    assert value(spark, T.approx_tokens(F.lit("abcde"))) == 2
    assert value(spark, T.word_count(F.lit(" a b\n c "))) == 3
    assert value(spark, T.lines(F.lit("a\r\nb\n"))) == ["a", "b"]
    assert value(spark, T.lines(F.lit(""))) == []
    assert value(spark, T.lines(F.lit("\n"))) == [""]


def test_plain_text_blocks_and_line_ranges(spark):
    rows = formats.plain_text_blocks(spark.createDataFrame([(1, "one two\nthree\n\n\n\nfour five")], "doc_id long, text string")).orderBy("pos").collect()
    assert [(r.text, r.line_start, r.line_end) for r in rows] == [("one two\nthree", 1, 2), ("four five", 6, 6)]
    assert [(b["runs"][0]["text"], b["line_start"], b["line_end"]) for b in readers.read("txt", b"one two\nthree\n\n\n\nfour five")] == [("one two\nthree", 1, 2), ("four five", 6, 6)]


def test_long_paragraph_is_cut_into_overlapping_windows(spark):
    words = [f"word{i}" for i in range(1000)]
    got = [r.text.split() for r in chunking.chunk_plain_text(files(spark, " ".join(words))).orderBy("ordinal").collect()]
    assert got == [words[0:384], words[336:720], words[672:1056]]


def test_null_and_empty_documents_have_no_chunks(spark):
    assert chunking.chunk_plain_text(files(spark, None, "", " \n\n ")).count() == 0


def brute_bm25(chunks, query, k):
    split = lambda t: [w for w in "".join(c.lower() if c.isascii() else c for c in "".join(c if c.isalnum() else " " for c in t)).split() if len(w.encode()) >= 2]
    terms = {key: split(t) for key, t in chunks.items()}
    n, avgdl = len(terms), sum(map(len, terms.values())) / len(terms)
    out = {}
    for q in split(query):
        df = sum(q in t for t in terms.values())
        for key, t in terms.items():
            if tf := t.count(q):
                out[key] = out.get(key, 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avgdl))
    return sorted(((round(s, 6), key) for key, s in out.items()), key=lambda x: (-x[0], x[1][1], x[1][0]))[:k]


def test_bm25_with_repeated_terms_filter_and_neighbours(spark):
    texts = ["red fox\n\nblue whale sings\n\nred red sky", "green field\n\nred barn", "fox fox fox"]
    chunks = chunking.chunk_plain_text(files(spark, *texts))
    flat = {(d, o): p for d, t in enumerate(texts) for o, p in enumerate(t.split("\n\n"))}
    for query in ("red fox", "red red fox", "nothing", ""):
        got = [(r.score, (r.doc_key, r.ordinal)) for r in bm25.search(chunks, query, 3).collect()]
        assert got == brute_bm25(flat, query, 3)
    only = bm25.file_filter(F.col("display_name"), F.col("digest"), "DOC-1.txt")
    assert [(r.doc_key, r.ordinal) for r in bm25.search(chunks, "red", 5, only).collect()] == [(1, 1)]
    asked = spark.createDataFrame([(7, "red fox"), (8, "whale"), (9, "")], "query_id long, query string")
    many = bm25.search_many(chunks, asked, 3).orderBy("query_id", "rank").collect()
    assert [(r.score, (r.doc_key, r.ordinal)) for r in many if r.query_id == 7] == brute_bm25(flat, "red fox", 3)
    for limit in (1, 2, 5):
        ways = [bm25.search_many(chunks, asked, limit, most_asked=n).orderBy("query_id", "rank").collect() for n in (0, 100)]
        assert ways[0] == ways[1] and len(ways[0]) > 1
    assert bm25.search_many(chunks, asked.where("query_id = 9"), 3).collect() == [] and bm25.search_many(chunks.where("false"), asked, 3).collect() == []
    near = bm25.neighbours(bm25.search(chunks, "whale", 1), chunks, 1)
    assert sorted((r.doc_key, r.ordinal) for r in near.collect()) == [(0, 0), (0, 1), (0, 2)]


def test_query_file_filter(spark):
    got = value(spark, bm25.split_file_filter(F.lit("what @ is @a.md in @b.md")))
    assert (got.wanted, got.rest) == ("a.md", "what @ is in @b.md")
    assert value(spark, bm25.split_file_filter(F.lit("plain"))).wanted is None


def test_packing_and_batches(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate([30, 30, 30])], "g long, ordinal long, cost long")
    assert context.pack_prefix(rows, "g", ["ordinal"], 70).count() == 2
    assert context.pack_prefix(rows, "g", ["ordinal"], 10, keep_first=True).count() == 1
    costs = [200] * 25 + [5000, 1]
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(costs)], "g long, ordinal long, cost long")
    got = {r.ordinal: r.batch for r in context.batches(rows, "g", 1000).collect()}
    batch = held = count = 0
    for i, c in enumerate(costs):
        if held + c > 1000 and count:
            batch, held, count = batch + 1, 0, 0
        held, count = held + c, count + 1
        assert got[i] == batch


def brute_retrieval(hits, cost, budget):
    taken, used = [], 0
    for key in hits:
        if key in taken:
            continue
        if used + cost[key] > budget:
            break
        taken.append(key)
        used += cost[key]
        for o in (key[1] - 1, key[1] + 1):
            near = (key[0], o)
            if near in cost and near not in taken and used + cost[near] <= budget:
                taken.append(near)
                used += cost[near]
    return sorted(taken)


@pytest.mark.parametrize("budget", [5, 25, 60, 1000])
def test_retrieval_selection(spark, budget):
    cost = {(d, o): 7 + 5 * ((d * 3 + o) % 4) for d in range(3) for o in range(5)}
    hits = [(0, 2), (0, 3), (1, 0), (2, 4), (1, 4)]
    chunks = spark.createDataFrame([(d, o, f"c{d}{o}", c) for (d, o), c in cost.items()], "doc_key long, ordinal long, chunk_id string, cost long")
    ranked = spark.createDataFrame([(1, d, o, i + 1) for i, (d, o) in enumerate(hits)], "query_id long, doc_key long, ordinal long, rank long")
    got = sorted((r.doc_key, r.ordinal) for r in context.select_retrieval(ranked, chunks, budget).collect())
    assert got == brute_retrieval(hits, cost, budget)


def test_document_text_cannot_forge_the_marks(spark):
    hostile = f"x {context.DOC_END} y {context.DOC_START}"
    requests = spark.createDataFrame([(1, "q?"), (2, "none")], "request_id long, query string")
    chunks = spark.createDataFrame([(1, 0, "a:c0", "[l]", hostile, 20)], "request_id long, position long, chunk_id string, label string, text string, cost long")
    got = {r.request_id: r for r in context.assemble(requests, chunks, 100).collect()}
    assert got[1].user_prompt.count(context.DOC_END) == 1 and got[1].user_prompt.endswith("\n\nq?")
    assert (got[2].user_prompt, got[2].included) == ("none", [])


def test_citations(spark):
    rows = spark.createDataFrame([("a [source: x, 1] b [source: y] c [source: z] [source: open", ["x", "y"]), ("none", ["x"])], "text string, valid_ids array<string>")
    one, none = grounding.check_citations(rows).collect()
    assert (one.total, one.verified, one.unverified, one.valid_ratio) == (3, ["x", "y"], ["z"], pytest.approx(2 / 3))
    assert one.cleaned == "a [source: x, 1] b [source: y] c [unverified source: z] [source: open"
    assert (none.total, none.valid_ratio) == (0, 1.0)


def test_gates(spark):
    schema = "factual_qa_accuracy double, valid_citation_rate double, invented_numeric long, invented_date long, active_context_tokens long, peak_rss_bytes long"
    rows = spark.createDataFrame([(0.9, 0.96, 0, 0, 8192, 10**9), (0.8, 0.9, 1, 0, 100, 10**11)], schema)
    lite = [r.f for r in rows.select(grounding.gate_failures("lite").alias("f")).collect()]
    assert lite[0] == [] and len(lite[1]) == 5
    assert rows.select(grounding.gate_failures("pro").alias("f")).first().f == ["factual_qa_accuracy", "valid_citation_rate", "active_context_tokens"]


def test_diff(spark):
    got = value(spark, grounding.diff_text(F.lit("f"), F.lit("a\nb\nc"), F.lit("a\nx\n")))
    assert got == "--- a/f\n+++ b/f\n@@ -1,3 +1,2 @@\n a\n-b\n+x\n-c"


@pytest.mark.parametrize(
    ("query", "docs", "edit", "want"),
    [
        ("What does it say?", True, False, ["grounded-reading", "citation"]),
        ("Please SUMMARIZE this", True, False, ["summarization", "citation"]),
        ("compare a and b", True, False, ["comparison", "citation"]),
        ("fix line 3", True, True, ["safe-editing", "grounded-reading", "citation"]),
        ("list files", False, False, ["discovery"]),
        ("hello", False, False, []),
        ("bandingkan", False, False, ["comparison", "citation"]),
    ],
)
def test_skills(spark, query, docs, edit, want):
    assert value(spark, grounding.select_skills(F.lit(query), F.lit(docs), F.lit(edit))) == want


def test_history_takes_smaller_messages_after_a_refusal(spark):
    rows = spark.createDataFrame([(1, 0, "user", "aaaa"), (1, 1, "user", "bbbbbbbb"), (1, 2, "user", "é"), (1, 3, "user", None)], "conv_id long, turn long, role string, text string")
    got = history.bounded(rows, 10, 7).orderBy("turn").collect()
    assert [(r.accepted, r.history_bytes) for r in got] == [(True, 4), (False, 4), (True, 6), (True, 6)]


def test_event_lines(spark):
    line = lambda s: 'data: {"choices":[{"delta":{"content":"%s"}}]}' % s
    rows = [(1, 0, line("a")), (1, 1, ": note"), (1, 2, line("b")), (1, 3, "data: [DONE]"), (1, 4, line("c")), (2, 0, line("x"))]
    got = {r.stream_id: r for r in history.decode_events(spark.createDataFrame(rows, "stream_id long, seq long, line string")).collect()}
    assert (got[1].answer, got[1].finished) == ("ab", True)
    assert (got[2].answer, got[2].finished) == ("x", False)


def test_markdown_stops_at_stray_hashes():
    kinds = [(b["kind"], b["line_start"], b["line_end"]) for b in markdown.blocks("#tag line\nmore\n#\n####### seven\n~~~\nin\n~~~")]
    assert kinds == [("paragraph", 1, 2), ("paragraph", 3, 3), ("paragraph", 4, 7)]


def test_markdown_mix():
    text = "# T\n\nA **b** and *c* [l](u).\n\n## S\n```rust\nfn x() {}\n```\n- one\n- two\n\n| h | i |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n"
    found = markdown.blocks(text)
    assert [b["kind"] for b in found] == ["heading", "paragraph", "heading", "code", "list", "table"]
    assert found[3]["language"] == "rust" and found[3]["section"] == "S"
    assert found[5]["headers"] == ["h", "i"] and len(found[5]["rows"]) == 2
    assert [r["kind"] for r in found[1]["runs"]] == ["text", "strong", "text", "emphasis", "text", "link", "text"]


BLOCKS = [
    {"kind": "heading", "level": 2, "runs": [{"kind": "text", "text": "Über {x} \\ 😀", "url": None}]},
    {"kind": "paragraph", "runs": [{"kind": "strong", "text": "12.000 €", "url": None}, {"kind": "text", "text": " & <more>", "url": None}]},
    {"kind": "list", "ordered": False, "items": [[{"kind": "text", "text": "eins", "url": None}], [{"kind": "text", "text": "zwei", "url": None}]]},
    {"kind": "table", "headers": ["a", "b"], "rows": [["1", "2"], ["3", ""]]},
]


@pytest.mark.parametrize("fmt", ["docx", "odt", "rtf"])
def test_written_files_read_back(fmt):
    text = " ".join(r["text"] for b in readers.read(fmt, writers.WRITERS[fmt](BLOCKS)) for r in [*(b.get("runs") or []), *(r for i in b.get("items") or [] for r in i), *({"text": c} for row in [b.get("headers") or [], *(b.get("rows") or [])] for c in row)])
    for piece in ("Über {x} \\ 😀", "12.000 €", " & <more>", "eins", "zwei", "3"):
        assert piece in text


@pytest.mark.parametrize(
    ("fmt", "data", "code"),
    [("txt", b"", "empty_file"), ("txt", b"a\0", "invalid_encoding"), ("md", b"\xff", "invalid_encoding"), ("docx", b"PK\x03\x04no", "corrupted"), ("pdf", b"%PDF-1.4 /Encrypt", "encrypted"), ("pdf", b"%PDF-1.4", "scanned_pdf_no_text"), ("doc", b"no", "signature_mismatch"), ("rtf", b"no", "signature_mismatch"), ("html", b"x", "unsupported_format")],
)
def test_unreadable_files(fmt, data, code):
    with pytest.raises(readers.ReadError) as e:
        readers.read(fmt, data)
    assert e.value.code == code


def test_rtf_destinations_leave_no_text():
    found = readers.read("rtf", rb"{\rtf1{\fonttbl{\f0 Arial;}}{\*\generator Tool;}{\info{\title T}}Caf\'e9 \u8364? x\par y}")
    assert [b["runs"][0]["text"] for b in found] == ["Café € x", "y"]


def test_errors_are_rows(spark):
    rows = spark.createDataFrame([(1, "txt", bytearray(b"a\n\nb")), (2, "pdf", bytearray(b"x"))], "doc_key long, format string, content binary")
    got = B.read_blocks(rows).orderBy("doc_key", "pos").collect()
    assert [(r.doc_key, r.error_code, r.pos) for r in got] == [(1, None, 0), (1, None, 1), (2, "signature_mismatch", None)]


def test_wide_table_is_split_under_its_header(spark):
    text = b"| alpha | beta | gamma |\n|---|---|---|\n| a1 | b1 | c1 |\n| a2 | b2 | c2 |\n| a3 | b3 | c3 |\n"
    rows = B.read_blocks(spark.createDataFrame([(1, "md", bytearray(text))], "doc_key long, format string, content binary"))
    parts = [r.text for r in render.split_table(rows, 12).orderBy("part").collect()]
    assert len(parts) >= 2 and all(p.startswith("alpha | beta | gamma\n") for p in parts)


def test_discovery(tmp_path, spark):
    for name, text in {"normal.md": "x", "staging/keep.md": "x", "staging/drop.md": "x", "logs/a.txt": "x", "b.log.md": "x", "root.md": "x", ".hidden.md": "x", "node_modules/p.md": "x", "pic.png": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / ".gitignore").write_text("# note\nlogs/\n*.log.md\n/root.md\nstaging/*\n!staging/keep.md\n")
    (tmp_path / "out.md").symlink_to("/etc/hostname")
    (tmp_path / "in.md").symlink_to(tmp_path / "normal.md")
    found = discovery.walk(str(tmp_path))
    assert [f["path"] for f in found["files"]] == ["in.md", "normal.md", "staging/keep.md"]
    assert found["symlinks"] == 1
    rows = spark.createDataFrame([("a.md", 5), (".x/a.md", 5), ("dist/a.md", 5), ("b.md", 60 << 20), ("c.png", 1)], "path string, byte_size long")
    assert [r.path for r in discovery.usable(rows).collect()] == ["a.md"]
    assert tuple(discovery.report(rows).first()) == (1, 5, 1)


def test_headings_and_pages_are_carried(spark):
    rows = spark.createDataFrame([(1, 0, "heading", "H", None), (1, 1, "paragraph", "a", 1), (1, 2, "page_break", "", 2), (1, 3, "paragraph", "b", None)], "g long, p long, kind string, text string, page int")
    got = history.carry_page(history.carry_heading(rows, "g", "p"), "g", "p").orderBy("p").collect()
    assert [r.nearest_heading for r in got] == ["H"] * 4 and [r.carried_page for r in got] == [None, 1, 2, 2]


def test_atomic_write(tmp_path):
    writers.atomic_write(str(tmp_path / "f"), b"1")
    writers.atomic_write(str(tmp_path / "f"), b"2")
    assert (tmp_path / "f").read_bytes() == b"2" and [p.name for p in tmp_path.iterdir()] == ["f"]


RUNS = "array<struct<kind: string, text: string, url: string>>"


def block_table(spark, *blocks):
    """Blocks of document 1 as the block table."""
    defaults = dict.fromkeys(B.FIELDS)
    rows = [(1, None, pos, *({**defaults, **b}[f] for f in B.FIELDS)) for pos, b in enumerate(blocks)]
    return spark.createDataFrame(rows, f"doc_key bigint, error_code string, pos bigint, {B.BLOCK}")


def named(spark, name="guide.txt"):
    return spark.createDataFrame([(1, "abcdefgh12", name)], "doc_key long, digest string, display_name string")


def said(text):
    return [("text", text, None)]


def test_block_chunks_keep_headings_and_pages(spark):
    blocks = block_table(
        spark,
        {"kind": "heading", "level": 1, "runs": said("Introduction"), "page": 1},
        {"kind": "paragraph", "runs": [("text", "It is a ", None), ("strong", "local-first", None), ("text", " assistant.", None)], "page": 1},
        {"kind": "page_break", "page": 2},
        {"kind": "paragraph", "runs": said("Privacy and security are mandatory.")},
        {"kind": "unsupported", "description": "chart"},
        {"kind": "list", "ordered": True, "items": [said("one"), said("two")]},
        {"kind": "code", "language": "rust", "code_text": "fn main() {}"},
        {"kind": "code", "code_text": "plain"},
    )
    got = chunking.chunk_blocks(blocks, named(spark)).orderBy("ordinal").collect()
    assert [r.text for r in got] == ["# Introduction", "It is a local-first assistant.", "Privacy and security are mandatory.", "1. one\n2. two", "```rust\nfn main() {}\n```", "```\nplain\n```"]
    assert [(r.ordinal, r.page) for r in got] == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 2), (5, 2)]
    assert {r.nearest_heading for r in got} == {"Introduction"} and got[4].terms == ["fn", "main"]
    assert got[2].chunk_id == "abcdefgh:c2" and got[2].token_count == 9
    label = chunking.citation_label(F.col("chunk_id"), F.col("display_name"), F.col("nearest_heading"), F.col("page"))
    assert [r[0] for r in chunking.chunk_blocks(blocks, named(spark)).orderBy("ordinal").select(label).collect()][2] == '[source: abcdefgh:c2, "guide.txt", § Introduction, Page 2]'


def test_oversized_blocks_are_cut(spark):
    words = " ".join(f"w{i}" for i in range(100))
    table = {"kind": "table", "headers": ["ID", "Name", "Description"], "rows": [[str(i), n, f"{n} record with detailed notes"] for i, n in enumerate(("Alpha", "Beta", "Gamma"))]}
    got = chunking.chunk_blocks(block_table(spark, {"kind": "paragraph", "runs": said(words)}, table), named(spark), 15, 2).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(len(got)))
    cut = [r.text for r in got if r.pos == 1]
    assert len(cut) >= 2 and all(t.startswith("ID | Name | Description\n") for t in cut)
    assert len([r for r in got if r.pos == 0]) > 5


@pytest.mark.parametrize("fmt", ["docx", "odt", "rtf"])
def test_titles_and_authors_are_written_and_read(fmt):
    found = readers.metadata(fmt, writers.WRITERS[fmt](BLOCKS, "Quarterly {Report} & Größe 😀"))
    assert found == {"title": "Quarterly {Report} & Größe 😀", "author": writers.CREATOR}


def test_dates_of_office_files():
    core = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d" xmlns:dcterms="t"><dc:title> T </dc:title><dcterms:created>2024-01-01</dcterms:created><dcterms:modified>2024-02-02</dcterms:modified></cp:coreProperties>'
    data = writers._zip([("word/document.xml", "<a/>"), ("docProps/core.xml", core)])
    assert readers.metadata("docx", data) == {"title": "T", "created": "2024-01-01", "modified": "2024-02-02"}
    assert readers.metadata("txt", b"x") == {} and readers.metadata("docx", b"PK") == {}


def odt_of(body):
    return writers._zip([("content.xml", f'<o:c xmlns:o="o" xmlns:text="t"><o:body><o:text>{body}</o:text></o:body></o:c>')])


def test_odd_files_are_errors_or_text_and_fail_no_job(spark):
    deep = "<text:span>" * 3000 + "deep" + "</text:span>" * 3000
    cases = {
        1: ("odt", odt_of('<text:p>a<text:s text:c="abc"/>b</text:p>')),
        2: ("odt", odt_of('<text:h text:outline-level="x">t</text:h>')),
        3: ("odt", odt_of(f"<text:p>{deep}</text:p>")),
        4: ("odt", odt_of('<text:p><text:s text:c="999999999"/></text:p>')),
        5: ("docx", b"PK\x03\x04" + b"\0" * 40),
        6: ("doc", bytes.fromhex("D0CF11E0A1B11AE1") + b"\xff" * 600),
    }
    rows = spark.createDataFrame([(k, f, bytearray(d)) for k, (f, d) in cases.items()], "doc_key long, format string, content binary")
    got = {r.doc_key: r for r in B.read_blocks(rows).collect()}
    assert got[1].runs[0].text == "a b" and got[2].level == 1 and got[3].runs[0].text == "deep"
    assert got[4].error_code == "too_large" and got[5].error_code == "corrupted" and got[6].error_code == "corrupted"
    assert B.read_metadata(rows).count() == 6


def test_headings_are_listed(spark):
    rows = B.read_blocks(spark.createDataFrame([(1, "md", bytearray(b"# A *b*\n\ntext\n\n## C\n"))], "doc_key long, format string, content binary"))
    assert [(r.pos, r.level, r.title, r.line_start) for r in B.headings(rows).orderBy("pos").collect()] == [(0, 1, "A b", 1), (2, 2, "C", 5)]


def test_system_prompt_layers(spark):
    skills = F.array(F.struct(F.lit("Citing").alias("title"), F.lit("Cite.").alias("content")), F.struct(F.lit("Editing").alias("title"), F.lit("Edit.").alias("content")))
    assert value(spark, context.system_prompt(F.lit("Policy."), skills, F.lit(" be brief \n"))) == "Policy.\n\n## Citing\nCite.\n\n## Editing\nEdit.\n\n## Client Preferences\nbe brief"
    none = F.array().cast("array<struct<title: string, content: string>>")
    assert value(spark, context.system_prompt(F.lit("Policy."), none, F.lit("  "))) == "Policy."


def test_reading_order(spark):
    taken = spark.createDataFrame([(1, 5, 1), (1, 4, 0), (1, 5, 0), (2, 4, 0)], "query_id long, doc_key long, ordinal long")
    chunks = spark.createDataFrame([(5, 0, "aa"), (5, 1, "aa"), (4, 0, "bb")], "doc_key long, ordinal long, digest string")
    got = {(r.query_id, r.doc_key, r.ordinal): r.read_at for r in context.reading_order(taken, chunks).collect()}
    assert got == {(1, 5, 0): 1, (1, 5, 1): 2, (1, 4, 0): 3, (2, 4, 0): 1}


@pytest.mark.parametrize(
    ("body", "error"),
    [
        ('{"messages": [{"role": "user", "content": "hi"}], "temperature": 2, "top_p": 0.5, "max_tokens": 1, "stream": true, "stop": null}', None),
        ("[]", "invalid_request"),
        ("no json", "invalid_request"),
        (None, "invalid_request"),
        ('{"tools": []}', "unsupported_field"),
        ('{"temperature": 2.1, "messages": []}', "invalid_parameter:temperature"),
        ('{"temperature": "1"}', "invalid_parameter:temperature"),
        ('{"top_p": -0.1}', "invalid_parameter:top_p"),
        ('{"max_tokens": 0}', "invalid_parameter:max_tokens"),
        ('{"max_tokens": 1.5}', "invalid_parameter:max_tokens"),
        ("{}", "invalid_parameter:messages"),
        ('{"messages": []}', "invalid_parameter:messages"),
        ('{"messages": {}}', "invalid_parameter:messages"),
        ('{"messages": [{"role": "user"}]}', "invalid_parameter:messages"),
        ('{"messages": [{"role": "tool", "content": "x"}]}', "invalid_parameter:messages"),
        ('{"messages": [{"role": "user", "content": 5}]}', "invalid_parameter:messages"),
        ('{"messages": [5]}', "invalid_parameter:messages"),
    ],
)
def test_chat_request_errors(spark, body, error):
    assert value(spark, service.chat_request_error(F.lit(body).cast("string"))) == error


def test_human_bytes(spark):
    got = [value(spark, service.human_bytes(F.lit(n).cast("long"))) for n in (0, 1023, 1024, 1536, 5 << 20, 3 << 30, 2048 << 30)]
    assert got == ["0 bytes", "1023 bytes", "1.0 KiB", "1.5 KiB", "5.0 MiB", "3.00 GiB", "2048.00 GiB"]


def test_counted_terms(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["x"] * 5)], "k long, t array<string>")
    got = [(r.k, r.term, r.tf) for r in rows.select("k", F.inline(T.counted(F.col("t")))).collect()]
    assert sorted(got) == [(1, "a", 1), (1, "b", 2), (4, "x", 5)]


def test_committed_answers(spark):
    rows = spark.createDataFrame([(1, "a", True, False), (2, "b", False, False), (3, "c", True, True)], "stream_id long, answer string, finished boolean, too_long boolean")
    assert [r.stream_id for r in history.committed(rows).collect()] == [1]


def test_answers_stream_over_batches_and_commit_when_finished(spark, tmp_path):
    from inkstone.streaming import answers

    schema = "stream_id long, seq long, line string"
    data = lambda s: 'data: {"choices":[{"delta":{"content":"%s"}}]}' % s
    batches = [[(1, 0, data("a")), (2, 0, data("x")), (3, 0, data("y" * 600_000))], [(1, 2, "data: [DONE]"), (1, 1, data("b")), (1, 3, data("late")), (2, 1, ": note"), (3, 1, data("y" * 600_000)), (3, 2, "data: [DONE]")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/lines")
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/lines")
    assert [(r.stream_id, r.answer) for r in answers.committed_once(spark, lines).collect()] == [(1, "ab")]


@pytest.mark.parametrize(
    ("body", "valid"),
    [
        ('{"schema_version": 1}', True),
        ('{"schema_version": 1, "write_workspaces": ["/a"], "remote_profiles": [{"name": "p", "base_url": "https://x/", "model": "m"}]}', True),
        ('{"schema_version": 2}', False),
        ("{}", False),
        ("[1]", False),
        ("x", False),
        (None, False),
        ('{"schema_version": 1, "more": 2}', False),
        ('{"schema_version": 1, "write_workspaces": ["a"]}', False),
        ('{"schema_version": 1, "write_workspaces": "/a"}', False),
        ('{"schema_version": 1, "remote_profiles": [{"name": "p", "base_url": "u", "model": "m"}, {"name": "p", "base_url": "u", "model": "m"}]}', False),
        ('{"schema_version": 1, "remote_profiles": [{"name": "", "base_url": "u", "model": "m"}]}', False),
        ('{"schema_version": 1, "remote_profiles": [{"name": "p"}]}', False),
        ('{"schema_version": 1, "write_workspaces": [' + ", ".join(['"/a"'] * 257) + "]}", False),
        ('{"schema_version": 1}' + " " * 70_000, False),
    ],
)
def test_settings(spark, body, valid):
    assert value(spark, service.settings_valid(F.lit(body).cast("string"))) is valid


def test_streams_have_bounds(spark):
    data = lambda s: 'data: {"choices":[{"delta":{"content":"%s"}}]}' % s
    rows = [(1, 0, data("a")), (2, 0, data("b" * 200)), (3, 0, data("c" * 60)), (3, 1, data("c" * 60)), (4, 0, data("d" * 30)), (4, 1, data("d" * 30)), *((5, i, data("e")) for i in range(6))]
    found = history.decode_events(spark.createDataFrame(rows, "stream_id long, seq long, line string"), max_line=150, max_answer=100, max_stream=240)
    assert {r.stream_id: r.too_long for r in found.collect()} == {1: False, 2: True, 3: True, 4: False, 5: True}
