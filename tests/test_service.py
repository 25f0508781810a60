from __future__ import annotations

import json

import pytest

from quire.operators import segment
from quire.operators.index import SectionIndex
from quire.operators.plans import PlanCompleteError, UnknownSectionError
from quire.operators.validation import InvalidIdError
from quire.plans import cli, plugins, tools
from quire.plans.service import NotFoundError, PlanExistsError, ReadingService
from quire.plans.workspace import Config, ConfigError, Workspace, load_config
from quire.streaming.ingest import block_stream, index_stream

SECTIONS = "doc_id string, section_id string, ord int, title string, level int, heading_path array<string>, text string"
ANNOTATIONS = "doc_id string, section_id string, concepts array<struct<slug:string,title:string,gloss:string>>, summary string"


def sections(spark, doc, *texts):
    return spark.createDataFrame([(doc, f"{doc}.s{i}", i, f"Title Number{i}", 1, [f"Title Number{i}"], t) for i, t in enumerate(texts)], SECTIONS)


def test_rebuild_changes_only_its_documents(spark, tmp_path):
    index = SectionIndex(spark, f"{tmp_path}/index")
    assert index.catalog().count() == 0 and index.search("x").count() == 0
    index.build(sections(spark, "a", "storage engine", "query").unionByName(sections(spark, "b", "storage storage")))
    assert [r["section_id"] for r in index.search("storage").collect()] == ["b.s0", "a.s0"]
    index.build(sections(spark, "a", "other words"), spark.createDataFrame([("a", "a.s0", [], "a summary")], ANNOTATIONS))
    assert [r["section_id"] for r in index.search("storage").collect()] == ["b.s0"]
    assert {r["doc_id"]: r["section_count"] for r in index.catalog().collect()} == {"a": 1, "b": 1}
    assert {r["doc_id"] for r in index.table("mentions").collect()} == {"b"}
    assert [r["summary"] for r in index.section_summary("a", "a.s0").collect()] == ["a summary"]
    assert index.graph("b").first()["next_id"] is None


def test_index_and_scan_agree_with_live_bm25(spark, tmp_path):
    from quire.operators import search

    rows = sections(spark, "a", "alpha beta alpha", "beta", "gamma").unionByName(sections(spark, "b", "alpha"))
    index = SectionIndex(spark, f"{tmp_path}/index")
    index.build(rows)
    key = lambda df: [(r["section_id"], r["score"]) for r in df.collect()]
    assert key(index.search("alpha beta beta")) == key(search.bm25(rows, "alpha beta beta"))


@pytest.fixture
def service(spark, tmp_path):
    made = ReadingService(spark, f"{tmp_path}/ws")
    blocks = "doc_id string, ord int, id string, type string, text string, level int, page_idx int, doc_title string, asset_path string"
    rows = [("book", 0, "b0", "title", "Storage Engines", 1, 0, "My Book", None), ("book", 1, "b1", "text", "Storage matters", None, 0, "My Book", None), ("book", 2, "b2", "title", "Query Planning", 1, 1, "My Book", None), ("book", 3, "b3", "image", "Fig", None, 1, "My Book", "f.png")]
    made.save_blocks(spark.createDataFrame(rows, blocks))
    made.save_sections(segment.by_heading(made.blocks()))
    spark.createDataFrame([("book", "images/f.png")], "doc_id string, path string").write.parquet(f"{tmp_path}/ws/files")
    return made


def test_reading_loop(service):
    assert [r["section_id"] for r in service.search("storage").collect()] == ["book.storage-engines"]
    service.build_index()
    assert [(r["doc_id"], r["title"], r["section_count"]) for r in service.list_documents().collect()] == [("book", "My Book", 2)]
    assert service.search("storage", "book").first()["snippet"] == "Storage matters"
    assert service.get_section("book", "book.query-planning").first()["assets"][0]["path"] == "images/f.png"
    assert [r["section_id"] for r in service.get_outline("book").collect()] == ["book.storage-engines", "book.query-planning"]
    assert {r["relation"] for r in service.get_related("book", "book.query-planning").collect()} == {"prev"}
    service.create_plan("book")
    with pytest.raises(PlanExistsError):
        service.create_plan("book")
    assert [r["section_id"] for r in service.get_next_section("book-plan").collect()] == ["book.storage-engines"]
    service.annotate_section("book", "book.storage-engines", [{"title": "LSM  Tree", "gloss": "g"}], "long\nsummary")
    assert service.mark_read("book-plan").first()["completed"] == 1
    assert service.mark_read("book-plan", "book.storage-engines").first()["completed"] == 1
    assert service.mark_read("book-plan").first()["done"]
    with pytest.raises(PlanCompleteError):
        service.mark_read("book-plan")
    with pytest.raises(UnknownSectionError):
        service.mark_read("book-plan", "nope")
    service.build_index()
    got = service.get_concept("lsm-tree", include_annotations=True)
    assert got["node"].first()["annotated_mention_count"] == 1
    assert got["mentions"].first()["summary"] == "long summary"
    assert service.get_concept("lsm-tree")["mentions"].first()["summary"] == ""
    context = service.get_context("book", "book.storage-engines")
    assert context["summary"].first()["summary"] == "long summary" and context["concepts"].count() == 1
    assert service.create_plan("book", overwrite=True) is not None
    assert service.list_plans().first()["completed"] == 0


@pytest.mark.parametrize("bad", ["../escape", "a/b", "..", "UPPER", "with space"])
def test_ids_are_checked(service, bad):
    with pytest.raises(InvalidIdError):
        service.get_outline(bad)


def test_missing_things_are_named(service):
    for call in (lambda: service.get_outline("none"), lambda: service.get_section("book", "nope"), lambda: service.get_concept("none"), lambda: service.mark_read("none")):
        with pytest.raises(NotFoundError):
            call()


def test_registry():
    parts = plugins.segmenters()
    assert parts.names() == ["bookmark", "heading", "token-page"] and len(list(parts.all())) == 3
    with pytest.raises(ValueError):
        parts.register("heading", segment.by_heading)
    with pytest.raises(KeyError):
        parts.get("nope")


def test_workspace_config(tmp_path):
    workspace = Workspace(tmp_path / "w").create()
    assert load_config(workspace).max_tokens == 800 and load_config(Workspace(tmp_path / "none")) == Config()
    workspace.config.write_text("[segmenter]\nmax_tokens = true\n")
    with pytest.raises(ConfigError):
        load_config(workspace)


def test_command_line(spark, tmp_path, capsys):
    root, source = str(tmp_path / "ws"), tmp_path / "Deep Work.md"
    source.write_text("# Deep Work\n\nStorage intro.\n\n## Focus\n\nStorage storage.\n")
    for args in (["init"], ["parse", str(source)], ["segment"], ["index"], ["search", "storage"], ["plan", "deep-work"], ["next", "deep-work-plan"], ["mark-read", "deep-work-plan"], ["documents"], ["outline", "deep-work"], ["plans"]):
        assert cli.main([root, *args], spark) == 0
    out = capsys.readouterr().out
    assert '"section_id":"deep-work.focus"' in out and '"completed":1' in out


def test_commands_can_be_repeated_and_only_told(spark, tmp_path, capsys):
    root, source, other = str(tmp_path / "ws"), tmp_path / "tides.md", tmp_path / "moons.md"
    source.write_text("# Tides\n\nIntro.\n\n## Ebb\n\nEbb words.\n")
    other.write_text("# Moons\n\nText.\n")
    run = lambda *args: cli.main([root, *args], spark)
    run("init")
    run("parse", str(source), "--dry-run")
    service = ReadingService(spark, root)
    assert service.blocks().count() == 0
    for _ in range(2):
        run("parse", str(source))
        run("segment")
    run("parse", str(other))
    run("segment", "--segmenter", "bookmark", "--doc-id", "moons")
    assert {(r["doc_id"], r["section_id"]) for r in service.sections().collect()} == {("tides", "tides.tides"), ("tides", "tides.ebb"), ("moons", "moons.moons")}
    (tmp_path / "ws/inbox/moons").mkdir()
    (tmp_path / "ws/inbox/moons/book.json").write_text(json.dumps({"book_id": "moons", "pdf": {"pages": 3, "bookmarks": [{"title": "First", "page_index": 0, "level": 1}]}}))
    run("segment", "--segmenter", "bookmark", "--doc-id", "moons")
    run("index")
    run("compile")
    run("index-concepts")
    run("stage", str(tmp_path / "staged"))
    assert (tmp_path / "ws/pages/books/tides/sections/tides.ebb.md").exists() and (tmp_path / "staged/tides.ebb.md").exists()
    assert '"links_without_page": 0' in capsys.readouterr().out
    with pytest.raises(ValueError, match="pages 0 to 2"):
        run("parse-book", "moons", "--command", "x", "--start-page", "7")
    with pytest.raises(ValueError, match="no range"):
        run("parse-book", "moons", "--command", "x", "--start-page", "2", "--end-page", "1")


def test_tools_answer_with_json_and_name_what_is_wrong(spark, service, tmp_path):
    box = tools.Tools(spark, service.root)
    assert set(box.describe()) == set(tools.NAMES) and box.describe()["search"]["arguments"]["query"]["required"]
    assert [h["section_id"] for h in box.call("search", query="storage")] == ["book.storage-engines"]
    assert box.call("create_plan", doc_id="book")[0]["plan_id"] == "book-plan"
    assert [s["section_id"] for s in box.call("get_next_section", plan_id="book-plan")] == ["book.storage-engines"]
    for name, arguments in (("nope", {}), ("get_section", {"doc_id": "book", "section_id": "book.x"}), ("search", {"query": "--"}), ("search", {"limit": 3}), ("create_plan", {"doc_id": "book"}), ("mark_read", {"plan_id": "book-plan", "section_id": "x"})):
        with pytest.raises(tools.ToolError):
            box.call(name, **arguments)
    blocks = "doc_id string, ord int, id string, type string, text string, level int, page_idx int, doc_title string"
    service.save_sections(segment.by_heading(spark.createDataFrame([("book", 0, "b0", "title", "Other", 1, 0, "B")], blocks)))
    with pytest.raises(tools.ToolError, match="has no more"):
        box.call("get_next_section", plan_id="book-plan")


def test_streaming_ingest(spark, tmp_path):
    schema = "doc_id string, ord int, id string, type string, text string, level int, page_idx int, doc_title string"
    rows = spark.createDataFrame([("d", 0, "b0", "title", "Streamed", 1, 0, "D"), ("d", 1, "b1", "text", "words", None, 0, "D")], schema)
    rows.write.parquet(f"{tmp_path}/in/one")
    index = SectionIndex(spark, f"{tmp_path}/index")
    query = index_stream(block_stream(spark, f"{tmp_path}/in/*", schema), index, f"{tmp_path}/cp", once=True)
    assert query.awaitTermination(60)
    assert [r["section_id"] for r in index.search("words").collect()] == ["d.streamed"]
