from __future__ import annotations

import pytest
from pyspark.errors import PySparkException

from quire.operators import assets, concepts, graph, plans, render, search, validation

SECTIONS = "doc_id string, section_id string, ord int, title string, level int, heading_path array<string>, text string"


def sections(spark, rows):
    return spark.createDataFrame([(d, f"{d}.{s}", i, t, level, [t], x) for i, (d, s, t, level, x) in enumerate(rows)], SECTIONS)


def test_parents_skip_missing_levels(spark):
    rows = sections(spark, [("d", "p1", "Part I", 1, ""), ("d", "c1", "C1", 2, ""), ("d", "c2", "C2", 3, ""), ("d", "p2", "Part II", 1, ""), ("d", "x", "X", 3, "")])
    got = {r["section_id"]: (r["parent_id"], r["prev_id"], r["next_id"], r["child_ids"]) for r in graph.section_graph(rows).collect()}
    assert got["d.c1"] == ("d.p1", "d.p1", "d.c2", ["d.c2"])
    assert got["d.x"] == ("d.p2", "d.p2", None, [])
    assert got["d.p1"][3] == ["d.c1"]


def test_parents_nest_at_any_level(spark):
    levels = [7, 8, 9, 10, 9, 12, 3, 40]
    rows = sections(spark, [("d", f"s{i}", "T", level, "") for i, level in enumerate(levels)])
    want = {f"d.s{i}": next((f"d.s{j}" for j in range(i - 1, -1, -1) if levels[j] < level), None) for i, level in enumerate(levels)}
    assert {r["section_id"]: r["parent_id"] for r in graph.with_parent(rows).collect()} == want


def test_search_folds_both_sides_alike(spark):
    texts = {"ko": "대한 한국 사람", "nfd": "\u1112\u1161\u11ab\u1100\u116e\u11a8", "ja": "みんな がんばれ", "lig": "the \ufb01nance o\ufb03ce", "wide": "\uff26\uff35\uff2c\uff2c text", "half": "\u00bd cup", "latin": "Crème brûlée", "math": "\U0001d400 set", "ascii": "plain Words"}
    rows = sections(spark, [("d", k, "T", 1, t) for k, t in texts.items()])
    for query, want in (("한국", {"ko", "nfd"}), ("がんばれ", {"ja"}), ("finance", {"lig"}), ("office", {"lig"}), ("full", {"wide"}), ("creme", {"latin"}), ("brûlée", {"latin"}), ("\U0001d400", {"math"}), ("words", {"ascii"}), ("WORDS", {"ascii"})):
        assert {r["section_id"][2:] for r in search.term_frequency(rows, query).collect()} == want, query
        assert {r["section_id"][2:] for r in search.bm25(rows, query).collect()} == want, query


def test_bm25_ranks_and_scan_counts(spark):
    rows = sections(spark, [("d", "a", "Storage", 1, "storage storage storage"), ("d", "b", "Other", 1, "nothing"), ("d", "c", "More", 1, "Stôrage once"), ("e", "z", "Z", 1, "empty")])
    assert [r["section_id"] for r in search.bm25(rows, "STORAGE").collect()] == ["d.a", "d.c"]
    assert {r["section_id"]: r["score"] for r in search.term_frequency(rows, "storage").collect()} == {"d.a": 4.0, "d.c": 1.0}
    assert {r["section_id"]: r["score"] for r in search.term_frequency(rows, "storage storage").collect()} == {"d.a": 8.0, "d.c": 2.0}
    assert search.bm25(rows, "storage", 10, ["e"]).count() == 0
    for bad in (("", 10), ("x", 0), ("--", 1)):
        with pytest.raises(search.InvalidQueryError):
            search.bm25(rows, *bad)


def test_concepts_merge_across_books_and_rank(spark):
    rows = sections(spark, [("a", "1", "Apache Iceberg", 1, "Schema Evolution The Metadata"), ("b", "1", "Apache Iceberg", 1, "schema-evolution matters")])
    nodes = {r["slug"]: (r["doc_count"], r["mention_count"]) for r in concepts.concept_nodes(concepts.merged_mentions(rows, annotations(spark, []))).collect()}
    assert nodes["apache-iceberg"] == (2, 2)
    assert nodes["schema-evolution"] == (2, 2)


def annotations(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, section_id string, concepts array<struct<slug:string,title:string,gloss:string>>, summary string")


def test_annotations_replace_prune_or_keep(spark):
    rows = sections(spark, [("d", "1", "Alpha", 1, ""), ("d", "2", "Beta", 1, ""), ("d", "3", "Gamma", 1, "")])
    marks = annotations(spark, [("d", "d.1", [("", "New Name", "g")], ""), ("d", "d.2", [], ""), ("d", "d.3", None, "sum"), ("d", "d.gone", [("x", "X", "")], "")])
    got = {(r["section_id"], r["slug"], r["gloss"], r["source"]) for r in concepts.merged_mentions(rows, marks).collect()}
    assert got == {("d.1", "new-name", "g", "agent"), ("d.3", "gamma", "", "auto")}


def test_annotation_concepts_are_deduplicated_and_checked(spark):
    one = concepts.resolve_annotations(annotations(spark, [("d", "s", [("", "A  b", ""), ("a-b", "Other", " late\n gloss "), ("z", "", "")], " a\nb ")])).first()
    assert [tuple(c) for c in one["concepts"]] == [("a-b", "A b", "late gloss"), ("z", "z", "")]
    assert one["summary"] == "a b"
    with pytest.raises(PySparkException, match="title or slug"):
        concepts.resolve_annotations(annotations(spark, [("d", "s", [("", "é", "")], "")])).collect()


def test_max_concepts_cuts_before_slugs_merge(spark):
    rows = sections(spark, [("d", "1", "Aaa", 1, "Bbb-xx The Bbb Xx")])
    assert [r["slug"] for r in concepts.extract_concepts(rows, 2).orderBy("position").collect()] == ["aaa", "bbb-xx"]
    assert [r["title"] for r in concepts.extract_concepts(rows, 3).orderBy("position").collect()] == ["Aaa", "Bbb Xx"]


def plan(spark):
    return (
        spark.createDataFrame([("p", "d", 2)], "plan_id string, doc_id string, daily_sections int"),
        spark.createDataFrame([("p", i, f"d.{i}") for i in range(4)], "plan_id string, pos long, section_id string"),
        spark.createDataFrame([("p", 0, "d.1")], "plan_id string, seq long, section_id string"),
    )


def test_plan_batches_marks_and_progress(spark):
    p, s, c = plan(spark)
    assert [r["section_id"] for r in plans.next_batch(p, s, c).orderBy("pos").collect()] == ["d.0", "d.2"]
    marks = spark.createDataFrame([("p", "d.3"), ("p", None)], "plan_id string, section_id string")
    after = plans.mark_read(s, c, marks)
    assert {r["section_id"] for r in after.collect()} == {"d.0", "d.1", "d.3"}
    again = plans.mark_read(s, after, spark.createDataFrame([("p", "d.3")], marks.schema))
    assert again.count() == 3
    assert plans.progress(p, s, after).first().asDict() == {"plan_id": "p", "doc_id": "d", "completed": 3, "total": 4, "done": False}
    with pytest.raises(PySparkException, match="no section"):
        plans.mark_read(s, c, spark.createDataFrame([("p", "nope")], marks.schema)).collect()
    full = spark.createDataFrame([("p", i, f"d.{i}") for i in range(4)], c.schema)
    assert plans.next_batch(p, s, full).count() == 0
    with pytest.raises(PySparkException, match="complete"):
        plans.mark_read(s, full, spark.createDataFrame([("p", None)], marks.schema)).collect()


def test_assets_resolve_inside_the_document_only(spark):
    own = spark.createDataFrame([("d", "d.s", ["t", "i", "u", "e", "a", "m"], "Fig 1")], "doc_id string, section_id string, block_ids array<string>, text string")
    rows = [("i", "image", "Fig 1", "x/../fig.png"), ("u", "image", "", "http://h/x.png"), ("e", "table", "", "../up.png"), ("a", "chart", "", "/abs.png"), ("m", "image", "", "missing.png"), ("t", "text", "x", "fig.png")]
    blocks = spark.createDataFrame([("d", *r) for r in rows], "doc_id string, id string, type string, text string, asset_path string")
    files = spark.createDataFrame([("d", "images/fig.png"), ("d", "fig.png"), ("d", "up.png"), ("d", "abs.png")], "doc_id string, path string")
    found = assets.section_assets(own, blocks, files)
    assert [(r["block_id"], r["pos"], r["path"]) for r in found.collect()] == [("i", 1, "images/fig.png")]
    assert "1 asset" in assets.asset_notes(own, found).first()["note"]


def test_validation_finds_bad_ids(spark):
    rows = spark.createDataFrame([("d", "a.b"), ("d", "a.b"), ("d", "../x")], "doc_id string, section_id string")
    assert [r["section_id"] for r in validation.unsafe_ids(rows).collect()] == ["../x"]
    assert [(r["section_id"], r["n"]) for r in validation.duplicate_ids(rows).collect()] == [("a.b", 2)]
    with pytest.raises(validation.InvalidIdError):
        validation.require_valid(rows)


def test_pages_link_concepts(spark):
    rows = sections(spark, [("d", "1", "Apache Iceberg", 1, ""), ("d", "2", "A|b Cd", 2, "")]).selectExpr("*", "cast(null as int) page_start", "cast(null as int) page_end", "cast(null as string) prev_id", "cast(null as string) next_id", "array() block_ids")
    found = concepts.extract_concepts(rows)
    pages = {r["section_id"]: r["content"] for r in render.linked_section_pages(rows, found).collect()}
    assert pages["d.1"].endswith("\n## Linked concepts\n\n- [[apache-iceberg|Apache Iceberg]]\n")
    assert "[[a-b-cd|A/b Cd]]" in pages["d.2"]
    index = render.book_indexes(rows, found).first()["content"]
    assert index.startswith("# d\n\n- [Apache Iceberg](sections/d.1.md)\n  - [A|b Cd](sections/d.2.md)\n\n## Concepts\n\n") and "(1 sections)" in index


def test_sources_change_only_with_content(spark):
    rows = sections(spark, [("d", "1", "T", 1, "x")])
    from pyspark.sql import functions as F

    before = render.staged_sources(rows).select("section_id", F.sha2("content", 256).alias("sha"))
    assert [r["changed"] for r in render.staged_sources(rows, before).collect()] == [False]
    assert [r["changed"] for r in render.staged_sources(rows.withColumn("text", F.lit("y")), before).collect()] == [True]
