"""Nulls, empty and very long texts, ties and repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest

import corpus_pipeline
from inkstone.llm import bpe, exact_dedup, html_main_text, language_crf, license_scan, near_dedup, packing, quality_gam, quality_rules, toxicity_chain
from inkstone.llm.queries import TOKENIZER

EXTRA = ["words", "node", "bucket", "digest", "votes", "posterior", "score", "bands", "root", "grp", "copies", "labels", "gated", "found", "__id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 20_000
PROSE = "The quick brown fox jumps over the lazy dog near the old river bank. " * 3
ROWS = [
    (1, None, "en", "s", None),
    (2, "", None, None, 0),
    (3, " \n\t ", "en", "s", 4),
    (4, PROSE, "en", "s", None),
    (4, PROSE, "en", "s", None),
    (5, PROSE.upper(), "de", "s", None),
    (6, PROSE, "en", "other", None),
    (7, LONG, "en", "s", None),
    (8, "one two three", "fr", "s", None),
    (9, "!!! 123 ???", "en", "s", None),
    (10, "x" * 50_000, "en", "s", None),
    (None, "no id here, but some words stand in this text", "en", "s", None),
]
DOCS = {
    "packing": lambda d, lab: packing.pack(d, TOKENIZER),
    "bpe": lambda d, lab: bpe.digests(d, TOKENIZER),
    "toxicity": toxicity_chain.classify,
    "near": lambda d, lab: near_dedup.resolve(d),
    "licenses": lambda d, lab: license_scan.scan(d),
    "exact": lambda d, lab: exact_dedup.resolve(d),
    "rules": lambda d, lab: quality_rules.judge(d),
    "language": lambda d, lab: language_crf.identify(d),
    "classifier": quality_gam.classify,
}


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    return frame.selectExpr("*", *(f"'x' AS `{c}`" for c in EXTRA))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(1, 11)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(DOCS))
def test_odd_rows_each_get_a_result(odd, labels, name):
    got = DOCS[name](odd, labels).collect()
    if name == "packing":
        assert sum(r.piece == 0 for r in got) == len(ROWS)
        assert sum(r.length == 1 for r in got if r.doc_id in (1, 2)) == 2
    else:
        assert len(got) == len(ROWS)
        assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", sorted(DOCS))
def test_empty_tables(odd, labels, name):
    assert DOCS[name](odd.where("false"), labels.where("false")).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "classifier"])
def test_without_labels(odd, labels, name):
    got = DOCS[name](odd, labels.where("false")).collect()
    assert {r.score for r in got} == ({0.5} if name == "classifier" else {got[0].score}) and len(got) == len(ROWS)


def test_exact_ties(odd):
    got = exact_dedup.resolve(odd).collect()
    prose = [r for r in got if r.doc_id in (4, 5, 6)]
    assert {(r.keep_id, r.group_size) for r in prose} == {(6, 4)} and [r.doc_id for r in prose if r.kept] == [6]
    assert [r.doc_id for r in got if r.kept and r.doc_id in (1, 2)] == [2]
    repeated = exact_dedup.resolve(odd.where("doc_id = 4")).collect()
    assert sorted(r.kept for r in repeated) == [False, True]


def test_near_ties(odd):
    got = near_dedup.resolve(odd).collect()
    assert sorted((r.doc_id, r.kept) for r in got if r.class_id == 4) == [(4, False), (4, True), (5, False), (6, False)]
    assert {r.class_id for r in got if r.doc_id in (1, 2, 3)} == {1}


def test_language_of_texts_without_letters(odd):
    got = {r.doc_id: r for r in language_crf.identify(odd).collect()}
    for doc_id in (1, 2, 3, 9):
        assert (got[doc_id].lang_pred, got[doc_id].score) == ("und", 0.0)
    assert got[4].lang_pred != "und"


def test_license_of_empty_texts(odd):
    got = {r.doc_id: r for r in license_scan.scan(odd).collect()}
    for doc_id in (1, 2, 3):
        assert (got[doc_id].n_words, got[doc_id].n_base, got[doc_id].first_word, got[doc_id].labels, got[doc_id].score) == (0, 0, None, "", 0.0)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>"), (4, "u", "<p>a</p>"), (4, "u", "<p>a</p>"), (None, "u", "<<>><a <b"), (5, "u", "<div>" * 5000 + "deep" + "</div>" * 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = html_main_text.extract(pages).collect()
    assert len(got) == len(rows) and [r.text for r in got if r.page_id in (1, 2, 3)] == ["", "", ""] and [r.text for r in got if r.page_id == 5] == ["deep"]
    assert html_main_text.extract(pages.where("false")).collect() == []


STAGES = corpus_pipeline.STAGES
#: Names that the stages use for helpers, now or earlier, and names that must be quoted.
HELPERS = ["row", "found", "base_failed", "votes", "posterior", "score", "digest", "id", "text_hash", "words_key", "__id", "__digest", "__hash", "__votes", "__score", "__v", "a.b", "x y", "struct"]


@pytest.mark.parametrize(("name", "stage"), STAGES[:-1], ids=[n for n, _ in STAGES[:-1]])
def test_stages_leave_clashing_columns_as_they_were(spark, sf_dir, name, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = docs.selectExpr("*", *(f"concat('{k}:', doc_id) AS `{c}`" for k, c in enumerate(HELPERS)), "struct(doc_id AS id, text AS `row`) AS nested")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = stage(spark, marked, sf_dir)
    assert out.columns == marked.columns and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    got = out.collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in stage(spark, docs, sf_dir).collect()} and got
    for r in got:
        assert [r[c] for c in HELPERS] == [f"{k}:{r.doc_id}" for k in range(len(HELPERS))] and r.nested == (r.doc_id, r.text)




@pytest.mark.parametrize(("name", "stage"), STAGES, ids=[n for n, _ in STAGES])
def test_stages_take_odd_and_empty_tables(spark, sf_dir, odd, name, stage):
    out = stage(spark, odd, sf_dir)
    if name != STAGES[-1][0]:
        assert out.columns == odd.columns
        assert out.count() <= len(ROWS)
    assert stage(spark, odd.where("false"), sf_dir).count() == 0


def test_dedup_stages_keep_one_of_each(spark, sf_dir, odd):
    exact = corpus_pipeline.without_copies(spark, odd, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in exact) == sorted(["2", "3", "6", "7", "8", "9", "10", "None"])
    near = corpus_pipeline.without_near_copies(spark, odd, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in near) == sorted(["1", "4", "7", "8", "9", "10", "None"])
