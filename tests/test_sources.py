from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException

from quire.sources import html, layout, markdown, readers
from quire.sources.routing import parser_for

SAMPLE = """# Tide Tables

Harbours differ;
so do moons.

Spring range
------------

1. gauge
2. datum
   - chart zero

***

* buoy

| port | metres |
| :-- | --: |
| Brest | 6.9 |
| Cork \\| Cobh | 3.7 |

~~~r
plot(tide)
~~~

$$
h = a \\cos(wt)
$$

![moon phases](pics/moon.svg)

> slack water
> lasts minutes

<section>kept as is</section>

### Neap range ###
"""


def test_markdown_constructs():
    got = [(b.type, b.level, b.text) for b in markdown.blocks_of(SAMPLE)]
    assert got == [
        ("title", 1, "Tide Tables"), ("text", None, "Harbours differ;\nso do moons."), ("title", 2, "Spring range"), ("list", None, "1. gauge\n2. datum\n  - chart zero"), ("list", None, "- buoy"),
        ("table", None, "port | metres\nBrest | 6.9\nCork | Cobh | 3.7"), ("text", None, "plot(tide)"), ("equation", None, "h = a \\cos(wt)"), ("image", None, "moon phases"), ("text", None, "slack water\nlasts minutes"),
        ("unknown", None, "<section>kept as is</section>"), ("title", 3, "Neap range"),
    ]


def test_markdown_metadata_and_lines(spark):
    rows = markdown.markdown_blocks(spark.createDataFrame([("d", SAMPLE, "/x.md"), ("e", None, None), ("f", "", None)], "doc_id string, text string, source_path string")).orderBy("ord").collect()
    assert {r["doc_id"] for r in rows} == {"d"}
    by_type = {r["type"]: r["metadata"] for r in rows}
    assert by_type["image"]["src"] == "pics/moon.svg"
    assert rows[0]["metadata"] == {"line_start": "1", "line_end": "1"}
    code = next(r for r in rows if r["metadata"].get("code"))
    assert code["metadata"]["language"] == "r"
    assert markdown.document_title(markdown.blocks_of("## x\n\n# T")) == "T"


@pytest.mark.parametrize("text", ["", "\n\n", "#", "```", "$$", "- ", "> ", "|", "| a |\n|---|", "***", "    code", "1)", "<", "![](", "\t- a\n\n\tb"])
def test_markdown_never_fails(text):
    markdown.blocks_of(text)


def test_layout_blocks(spark):
    page = {
        "page_idx": 2,
        "para_blocks": [
            {"type": "table", "bbox": [5, 6, 70, 80], "blocks": [{"type": "table_caption", "lines": [{"spans": [{"content": "Heights by "}, {"content": "port "}]}]}, {"type": "table_body", "lines": [{"spans": [{"type": "table", "image_path": "t/heights.png"}]}]}]},
            {"type": "text", "lines": [{"spans": [{"content": "Low"}]}, {"spans": [{"content": "water"}]}]},
            {"type": "title", "lines": [{"spans": [{"content": "Currents"}]}]},
            {"type": "interline_equation", "content": "v = s / t"},
            {"type": "stamp", "lines": None},
        ],
    }
    rows = layout.layout_blocks(spark.createDataFrame([("d", json.dumps({"pdf_info": [{"page_idx": 1, "para_blocks": None}, page]}))], "doc_id string, json string")).orderBy("ord").collect()
    assert [(r["id"], r["type"], " ".join(r["text"].split()), r["level"], r["asset_path"]) for r in rows] == [
        ("p2.b0", "table", "Heights by port", None, "t/heights.png"), ("p2.b1", "text", "Low water", None, None), ("p2.b2", "title", "Currents", 1, None), ("p2.b3", "equation", "v = s / t", None, None),
        ("p2.b4", "unknown", "", None, None),
    ]
    assert rows[0]["bbox"] == [5.0, 6.0, 70.0, 80.0]
    with pytest.raises(PySparkException, match="pdf_info"):
        layout.layout_blocks(spark.createDataFrame([("d", "{}")], "doc_id string, json string")).collect()


def test_html_blocks(spark):
    page = "<h1>T</h1><p>a <b>b</b></p><ul><li>x<li>y</ul><script>no</script><table><tr><td>1<td>2</tr></table><img src=i.png alt=cap>"
    rows = html.html_blocks(spark.createDataFrame([("d", page), ("e", None)], "doc_id string, html string")).orderBy("ord").collect()
    assert [(r["type"], r["text"], r["level"]) for r in rows] == [("title", "T", 1), ("text", "a b", None), ("list", "x", None), ("list", "y", None), ("table", "1 | 2", None), ("image", "cap", None)]


def test_routing():
    assert [parser_for(n) for n in ("a/B_Middle.json", "x.MD", "y.html", "tar.gz/z.mdx")] == ["layout-json", "markdown", "converted", "markdown"]
    for name in ("x.json", "x.pdf", "x.xyz", "x"):
        with pytest.raises(layout.UnsupportedSourceError):
            parser_for(name)


def test_interchange_files_round_trip(spark, tmp_path):
    blocks = markdown.markdown_blocks(spark.createDataFrame([("d", SAMPLE, "/x.md")], "doc_id string, text string, source_path string")).selectExpr("*", "'T' doc_title")
    readers.write_documents(blocks, f"{tmp_path}/docs")
    back = readers.read_documents(spark, f"{tmp_path}/docs", one_per_file=False).orderBy("ord").collect()
    assert [(b["id"], b["ord"], b["type"]) for b in back] == [(b["id"], b["ord"], b["type"]) for b in blocks.orderBy("ord").collect()]
    rows = spark.createDataFrame([("d", "d.a", 0, "A", 1, ["A"], "x"), ("d", "d.b", 1, "B", 1, ["B"], "")], "doc_id string, section_id string, ord int, title string, level int, heading_path array<string>, text string")
    readers.write_sections(rows, f"{tmp_path}/sections")
    assert [r["section_id"] for r in readers.read_sections(spark, f"{tmp_path}/sections").orderBy("ord").collect()] == ["d.a", "d.b"]
    assert readers.count_sections(spark, f"{tmp_path}/sections") == 2
    many = spark.createDataFrame([(f"d{i % 3}", f"d{i % 3}.s{i}", i, "T", 1, ["T"], "x" * 50) for i in range(600)], rows.schema)
    readers.write_sections(many.coalesce(1), f"{tmp_path}/many")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # several splits a file
    try:
        back = readers.read_sections(spark, f"{tmp_path}/many").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r["section_id"], r["ord"]) for r in back} == {(f"d{i % 3}.s{i}", i // 3) for i in range(600)}


def test_annotations_and_bookmarks_are_guarded(spark, tmp_path):
    folder = tmp_path / "annotations" / "d"
    folder.mkdir(parents=True)
    (folder / "d.a.json").write_text(json.dumps({"doc_id": "d", "section_id": "d.a", "concepts": []}))
    (folder / "d.b.json").write_text(json.dumps({"doc_id": "other", "section_id": "d.b"}))
    (folder / "d.c.json").write_text("{broken")
    (folder / "d.e.json").write_text(json.dumps({"doc_id": "d", "section_id": "d.x"}))
    rows = readers.read_annotations(spark, str(tmp_path / "annotations")).collect()
    assert [(r["section_id"], r["concepts"], r["summary"]) for r in rows] == [("d.a", [], "")]
    marks = [{"title": " A ", "page_index": 1, "level": 1}, {"title": "", "page_index": 1, "level": 1}, {"title": "B", "page_index": "x", "level": 1}, {"title": "C", "page_index": None, "level": 2}, {"title": "D", "page_index": 3}]
    (tmp_path / "book.json").write_text(json.dumps({"book_id": "d", "pdf": {"bookmarks": marks}}))
    assert [(r["title"], r["page_index"], r["level"]) for r in readers.read_bookmarks(spark, str(tmp_path / "book.json")).orderBy("pos").collect()] == [("A", 1, 1), ("C", None, 2)]
