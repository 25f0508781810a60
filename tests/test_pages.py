from __future__ import annotations

import json
import sys

import pytest

from quire.operators import segment
from quire.plans import cli
from quire.sources import converted, external, outline, pages

BLOCKS = "doc_id string, ord int, id string, type string, text string, level int, page_idx int, doc_title string"


@pytest.fixture
def sections(spark):
    rows = [("book", 0, "b0", "title", "Storage Engines", 1, 0, "Book"), ("book", 1, "b1", "text", "words", None, 0, "Book"), ("book", 2, "b2", "title", "Query Planning", 1, 1, "Book")]
    return segment.by_heading(spark.createDataFrame(rows, BLOCKS))


def test_books_are_compiled_to_files(sections, tmp_path):
    assert pages.compile_books(sections, str(tmp_path / "plain")) == {"written": 3, "unchanged": 0}
    assert pages.compile_books(sections, str(tmp_path / "plain")) == {"written": 0, "unchanged": 3}
    for book in ("book", "other"):
        (tmp_path / f"linked/{book}/sections").mkdir(parents=True)
        (tmp_path / f"linked/{book}/sections/stale.md").write_text("old")
    pages.compile_books(sections, str(tmp_path / "linked"), linked=True)
    assert not (tmp_path / "linked/book/sections/stale.md").exists() and (tmp_path / "linked/other/sections/stale.md").exists()
    assert "## Concepts" in (tmp_path / "linked/book/README.md").read_text()
    assert "[[storage-engines|Storage Engines]]" in (tmp_path / "linked/book/sections/book.storage-engines.md").read_text()


def test_staging_is_idempotent_and_can_take_completed_only(spark, sections, tmp_path):
    done = spark.createDataFrame([("book.storage-engines",)], "section_id string")
    assert pages.stage_sources(sections, f"file://{tmp_path}/s", done) == {"written": 1, "unchanged": 0}
    assert pages.stage_sources(sections, f"file://{tmp_path}/s") == {"written": 1, "unchanged": 1}


def test_concept_pages_are_rewritten(spark, sections, tmp_path):
    from quire.operators import concepts

    notes = spark.createDataFrame([("book", "book.storage-engines", [("", "LSM", "a gloss")], "sum")], "doc_id string, section_id string, concepts array<struct<slug:string,title:string,gloss:string>>, summary string")
    titles = spark.createDataFrame([("book", "My Book")], "doc_id string, book_title string")
    pages.compile_concepts(concepts.merged_mentions(sections, notes), sections, notes, titles, str(tmp_path / "c"))
    assert (tmp_path / "c/lsm.md").read_text() == "# LSM\n\nMentioned in 1 book · 1 section.\n\n## My Book\n\n- [Storage Engines](../books/book/sections/book.storage-engines.md) — a gloss (agent-verified)\n  > sum\n"


def test_outline_is_flattened_in_order():
    item = lambda t: type("Item", (), {"title": t})()
    got = list(outline.flatten_outline([item(" A "), [item("B"), [item("C")]], item(" "), item("D")], lambda i: len(i.title)))
    assert [(b.title, b.page_index, b.level) for b in got] == [("A", 3, 1), ("B", 1, 2), ("C", 1, 3), ("D", 1, 1)]


def test_books_are_registered(tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF broken")
    manifest = json.loads(pages.register_book(tmp_path / "x.pdf", tmp_path / "inbox", "x", "X", outline.PdfMetadata("T", None, 3, [outline.Bookmark("A", 1, 1)])).read_text())
    assert manifest["pdf"]["bookmarks"] == [{"title": "A", "page_index": 1, "level": 1}] and manifest["status"] == "registered"
    assert json.loads(pages.register_book(tmp_path / "x.pdf", tmp_path / "inbox", "y", "Y").read_text())["pdf"]["pages"] == 0
    with pytest.raises(ValueError):
        pages.register_book(tmp_path / "x.txt", tmp_path, "x", "X")


def test_external_parser(tmp_path):
    assert external.resolve_options("fast-text", table=True, url=None).table is True
    assert external.resolve_options().method == "auto"
    with pytest.raises(ValueError):
        external.resolve_options("nope")
    assert external.arguments(external.ParserOptions(method="txt", table=False, start_page=0)) == ["--method", "txt", "--table", "false", "--start-page", "0"]
    code = "import sys, pathlib; pathlib.Path(sys.argv[sys.argv.index('-o') + 1], 'b_middle.json').write_text('{}')"
    assert external.run_parser([sys.executable, "-c", code], tmp_path / "b.pdf", tmp_path / "w").name == "b_middle.json"
    for command, timeout in (([sys.executable, "-c", "raise SystemExit('bad')"], 5), (["/no/such/tool"], 5), ([sys.executable, "-c", "import time; time.sleep(9)"], 0.2), ([sys.executable, "-c", ""], 5)):
        with pytest.raises(external.ParserRunError):
            external.run_parser(command, tmp_path / "b.pdf", tmp_path / "w2", timeout=timeout)


def test_converted_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("tool,cost\n\nemail,high\n")
    (tmp_path / "b.txt").write_text("# T\n\ntext")
    (tmp_path / "c.html").write_text("<h1>H</h1><p>x")
    rows = cli.parsed_blocks(spark, str(tmp_path / "*.*"), "converted").orderBy("doc_id", "ord").collect()
    assert [(r["doc_id"], r["type"], r["text"], r["doc_title"]) for r in rows] == [("a", "table", "tool | cost\nemail | high", "a"), ("b", "title", "T", "T"), ("b", "text", "text", "T"), ("c", "title", "H", "H"), ("c", "text", "x", "H")]
    with pytest.raises(converted.MissingConverterError):
        converted.file_blocks("docx", b"")
