"""Queries against their SQL on a table with empty documents, texts of spaces alone and texts with odd spaces at their ends;
workspaces with empty files."""

import os

import duckdb
import pytest

from inkstone.plans import catalogue
from inkstone.sources import workspace

from .test_catalogue import rows

TEXTS = ["", "", "", " ", "a line\nanother.\n", "\n", " x ", "\x0bx\x0b", "x  ", "x", "  two  spaces  ", "\f"]


@pytest.fixture(scope="module")
def odd_dir(spark, sf_dir, tmp_path_factory):
    """The smallest tables; every document's text is one of TEXTS."""
    root = str(tmp_path_factory.mktemp("odd"))
    for file in os.listdir(sf_dir):
        if file != "documents.parquet":
            os.symlink(f"{sf_dir}/{file}", f"{root}/{file}")
    table = [(i, TEXTS[i % len(TEXTS)], ["en", "de"][i % 2], f"src{i % 3}", len(TEXTS[i % len(TEXTS)])) for i in range(200)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    return root


@pytest.mark.parametrize("name", ["markdown_blocks", "markdown_inline_runs", "render_markdown", "render_plain", "positional_diff_counts", "positional_diff_text", "workspace_files", "workspace_report"])
def test_query_matches_sql_on_empty_documents(spark, odd_dir, name):
    got = catalogue.queries()[name](spark, odd_dir)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{odd_dir}/documents.parquet/*.parquet'")
    want = con.sql(catalogue.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("at_once", [1, 10_000])
def test_every_file_is_listed_and_read(spark, tmp_path, monkeypatch, at_once):
    """Empty files, odd names and links, in a folder with a space in its name, over one round and over many."""
    monkeypatch.setattr(workspace, "LISTED_AT_ONCE", at_once)
    root = tmp_path / "a folder"
    tree = {"empty.md": "", "_under.md": "u", "a/b/c/d.txt": "d", "a/b/é [1]*{x}?%20.md": "e", "a/.hidden/x.md": "x", ".y.md": "y", "a/.gitignore": "", "z/empty.TEXT": ""}
    for name, text in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "a/up").symlink_to(root)
    (root / "gone.md").symlink_to(root / "nothing")
    (root / "same.md").symlink_to(root / "_under.md")
    want = {p: t for p, t in tree.items() if "/." not in f"/{p}"} | {"same.md": "u"}
    files = workspace.listed(spark, str(root))
    assert {r.path: r.byte_size for r in files.collect()} == {p: len(t) for p, t in want.items()} and files.count() == len(want)
    found = workspace.discovered(files, workspace.rule_files(spark, str(root), files))
    assert {r.path: bytes(r.content).decode() for r in workspace.read(spark, str(root), found).collect()} == want


def test_the_driver_holds_no_list_of_a_workspace_s_files(spark, tmp_path):
    for n in range(50):
        (tmp_path / f"d{n}.md").write_text("x")
    files = workspace.listed(spark, str(tmp_path))
    found = workspace.discovered(files, workspace.rule_files(spark, str(tmp_path), files))
    read = workspace.read(spark, str(tmp_path), found)
    assert read.count() == 50 and not [f for f in read.inputFiles() if f.endswith(".md")]
