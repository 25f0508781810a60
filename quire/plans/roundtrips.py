"""Queries that write what others make and read it back: interchange files, the index, the service's tables, page files; and small literal tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import terms
from quire.operators import concepts, graph
from quire.operators.index import SectionIndex
from quire.plans.service import ReadingService
from quire.sources import html, markdown, pages, readers, views
from quire.sources.routing import parser_for


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``; a session on one machine may have none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='quire-')}"
    return f"{at.rstrip('/')}/quire/{name}-{uuid.uuid4().hex}"


def sections_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections as JSONL and back: ``ord`` counts them anew."""
    path = scratch(spark, "sections")
    readers.write_sections(views.v_sections(spark, sf_dir), path)
    return readers.read_sections(spark, path).select("doc_id", "section_id", "ord", "title", "level", "text")


def documents_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' blocks as JSON documents and back."""
    path = scratch(spark, "documents")
    readers.write_documents(views.v_turn_blocks(spark, sf_dir), path)
    return readers.read_documents(spark, path, one_per_file=False).select("doc_id", "doc_title", "ord", "id", "type", "text", "level", "page_idx")


def _index(spark: SparkSession, sf_dir: str, annotated: bool = False, before: str = "false") -> SectionIndex:
    """An index of every section; one of the sections ``before`` was built first, which the second build replaces."""
    index, sections = SectionIndex(spark, scratch(spark, "index")), views.v_sections(spark, sf_dir)
    if before != "false":
        index.build(sections.where(before))
    index.build(sections, views.v_annotations(spark, sf_dir) if annotated else None)
    return index


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.plans.queries import QUERY

    return _index(spark, sf_dir).search(QUERY, 10).select("doc_id", "section_id", "title", F.round("score", 6).alias("score"))


def index_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).table("sections").select("section_id", "parent_id", "prev_id", "next_id", F.array_join("child_ids", ",").alias("child_ids"))


def index_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, before="level > 1").catalog().select("doc_id", "title", "section_count")


def index_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.concept_nodes(_index(spark, sf_dir, annotated=True).table("mentions"))


def _service(spark: SparkSession, sf_dir: str) -> ReadingService:
    """A workspace whose sections were saved twice, which is as once."""
    service = ReadingService(spark, scratch(spark, "workspace"))
    for _ in range(2):
        service.save_sections(views.v_sections(spark, sf_dir))
    return service


def service_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _service(spark, sf_dir).list_documents().select("doc_id", "title", "section_count")


def service_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of one book with two sections marked, one of them twice, and what is next."""
    service = _service(spark, sf_dir)
    service.create_plan("src1", "reading", 4)
    first = service.get_next_section("reading").first()["section_id"]
    service.mark_read("reading")
    service.mark_read("reading", first)
    service.mark_read("reading")
    progress = service.list_plans().select("plan_id", "doc_id", "completed", "total", "done")
    return progress.crossJoin(service.get_next_section("reading").select("section_id"))  # one plan


def book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books' index pages as files and back."""
    folder = scratch(spark, "books")
    unpaged = {"page_start": "int", "page_end": "int", "prev_id": "string", "next_id": "string", "block_ids": "array<string>"}
    pages.compile_books(views.v_sections(spark, sf_dir).withColumns({c: F.lit(None).cast(t) for c, t in unpaged.items()}), folder)
    files = spark.read.text(f"{folder}/*/README.md", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), "content")


NAMES = ("a/b_MIDDLE.json", "x.md", "x.MDX", "y.htm", "z.docx", "q.csv", "_middle.json")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, parser_for(n)) for n in NAMES], "name string, parser string")


LEVELS = (1, 3, 9, 12, 10, 9, 2, 40)


def deep_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("d", f"d.s{i}", i, level) for i, level in enumerate(LEVELS)], "doc_id string, section_id string, ord int, level int")
    return graph.with_parent(rows).select("section_id", "parent_id")


SCRIPTS = {"Straße ÉCOLE": "straße ecole", "ﬁnance oﬃce": "finance office", "ＦＵＬＬ ｗｉｄｔｈ": "full width", "がんばれ": "かんはれ", "½ cup": "1 2 cup", "𝐀b": "Ab"}


def script_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in SCRIPTS], "text string").select("text", F.array_join(terms(F.col("text")), " ").alias("terms"))


MARKDOWN = "# Tide\n\nOne\nline.\n\nRange\n---\n\n- a\n- b\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n$$\nh = 1\n$$\n\n![moon](m.png)\n\n```r\ncode\n```\n"
MARKDOWN_BLOCKS = (("title", 1, "Tide"), ("text", None, "One\nline."), ("title", 2, "Range"), ("list", None, "- a\n- b"), ("table", None, "x | y\n1 | 2"), ("equation", None, "h = 1"), ("image", None, "moon"), ("text", None, "code"))


def markdown_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.markdown_blocks(spark.createDataFrame([("d", MARKDOWN, None)], "doc_id string, text string, source_path string")).select("ord", "type", "level", "text")


HTML = "<h2>T &amp; t</h2><p>a <b>b</b></p><ul><li>x<li>y</ul><script>no</script><table><tr><td>1<td>2</table><img src=i.png alt=cap>"
HTML_BLOCKS = (("title", 2, "T & t"), ("text", None, "a b"), ("list", None, "x"), ("list", None, "y"), ("table", None, "1 | 2"), ("image", None, "cap"))


def html_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_blocks(spark.createDataFrame([("d", HTML)], "doc_id string, html string")).select("ord", "type", "level", "text")


QUERIES = {
    f.__name__: f
    for f in (sections_jsonl, documents_json, index_search, index_graph, index_catalog, index_concepts, service_documents, service_plan, book_files, routes, deep_parents, script_terms, markdown_fixture, html_fixture)
}


def _text(x: str | None) -> str:
    return "NULL" if x is None else " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in x.split("\n"))


def _blocks(rows: tuple[tuple[str, int | None, str], ...]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{kind}', {'CAST(NULL AS INTEGER)' if level is None else level}, {_text(text)})" for i, (kind, level, text) in enumerate(rows)) + ") t(ord, type, level, text)"


def oracle(sections: str, turns: str, parents: str, merged: str, tokens: str, bm25: str, outline: str) -> dict[str, str]:
    """SQL of the queries, from the parts that the other queries' SQL is made of."""
    parser = {"a/b_MIDDLE.json": "layout-json", "x.md": "markdown", "x.MDX": "markdown", "y.htm": "converted", "z.docx": "converted", "q.csv": "converted", "_middle.json": "layout-json"}
    return {
        "sections_jsonl": f"WITH {sections} SELECT doc_id, section_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord, title, level, text FROM v_sections",
        "documents_json": f"WITH {turns} SELECT doc_id, 'Talk ' || doc_id AS doc_title, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS ord, id, type, text, level, page_idx FROM v_turns",
        "index_search": f"WITH {sections}, {tokens} {bm25}",
        "index_graph": f"WITH {sections}, {parents} SELECT p.section_id, p.parent_id, p.prev_id, p.next_id, coalesce((SELECT string_agg(c.section_id, ',' ORDER BY c.ord) FROM parents c WHERE c.parent_id = p.section_id), '') AS child_ids FROM parents p",
        "index_catalog": "SELECT source AS doc_id, source AS title, count(*) AS section_count FROM documents GROUP BY source",
        "index_concepts": f"WITH {merged} SELECT * FROM nodes",
        "service_documents": "SELECT source AS doc_id, source AS title, count(*) AS section_count FROM documents GROUP BY source",
        "service_plan": f"""WITH {sections}, own AS (SELECT section_id, row_number() OVER (ORDER BY ord) AS nr, count(*) OVER () AS total FROM v_sections WHERE doc_id = 'src1')
SELECT 'reading' AS plan_id, 'src1' AS doc_id, 2 AS completed, total, total <= 2 AS done, section_id FROM own WHERE nr BETWEEN 3 AND 6""",
        "book_files": f"SELECT doc_id || '/README.md' AS name, content FROM ({outline})",
        "routes": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in parser.items()) + ") t(name, parser)",
        "deep_parents": "SELECT * FROM (VALUES ('d.s0', CAST(NULL AS VARCHAR)), ('d.s1', 'd.s0'), ('d.s2', 'd.s1'), ('d.s3', 'd.s2'), ('d.s4', 'd.s2'), ('d.s5', 'd.s1'), ('d.s6', 'd.s0'), ('d.s7', 'd.s6')) t(section_id, parent_id)",
        "script_terms": "SELECT * FROM (VALUES " + ", ".join(f"({_text(x)}, {_text(y)})" for x, y in SCRIPTS.items()) + ") t(text, terms)",
        "markdown_fixture": _blocks(MARKDOWN_BLOCKS),
        "html_fixture": _blocks(HTML_BLOCKS),
    }
