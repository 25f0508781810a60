"""The engine's queries over the test tables; each has its SQL under the same name in ``oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import slugify, snippet, terms, token_count
from quire.operators import assets, concepts, graph, plans, render, search, segment, validation
from quire.sources import html, layout, markdown, views

QUERY, SCOPE_QUERY, CONCEPT = "Ering onti été queue", "thti erly", "thtion"


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.v_sections(spark, sf_dir)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.merged_mentions(_sections(spark, sf_dir), views.v_annotations(spark, sf_dir))


def _detailed(spark: SparkSession, sf_dir: str, marked: bool = False) -> DataFrame:
    return concepts.detailed_mentions(_merged(spark, sf_dir), _sections(spark, sf_dir), views.v_annotations(spark, sf_dir), marked)


def fts_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(_sections(spark, sf_dir), QUERY, 10).select("doc_id", "section_id", "title", F.round("score", 6).alias("score"))


def fts_bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(_sections(spark, sf_dir), SCOPE_QUERY, 20, ["src1", "src3", "src5"]).select("doc_id", "section_id", "title", F.round("score", 6).alias("score"))


def scan_tf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_frequency(_sections(spark, sf_dir), "onti ering onti").select("doc_id", "section_id", "title", "score")


def search_union_indexed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = _sections(spark, sf_dir)
    indexed = sections.where(F.col("doc_id").rlike("^src[0-9]$")).select("doc_id")
    return search.search(sections, SCOPE_QUERY, indexed, 25).select("doc_id", "section_id", "title", F.round("score", 6).alias("score"))


def search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("section_id", snippet(F.col("text"), ["onti", "ering"]).alias("snippet"))


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(_sections(spark, sf_dir)).select("section_id", "term", "tf")


def slugify_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("section_id", slugify(F.col("title")).alias("slug"))


def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sections(spark, sf_dir).select("doc_id", F.col("ord").alias("nr"), "title")
    return segment.unique_slugs(rows).select("doc_id", "nr", "slug")


def section_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_neighbours(_sections(spark, sf_dir)).select("section_id", "prev_id", "next_id")


def section_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.outline(_sections(spark, sf_dir))


def section_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.section_graph(_sections(spark, sf_dir)).select("section_id", F.array_join("child_ids", ",").alias("child_ids"))


def section_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related(_sections(spark, sf_dir))


def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of sections of level 3 are made to lead nowhere."""
    linked = graph.with_neighbours(_sections(spark, sf_dir)).select("doc_id", "section_id", "level", "prev_id", "next_id")
    broken = linked.withColumns({c: F.when(F.col("level") == 3, F.concat(c, F.lit("-gone"))).otherwise(F.col(c)) for c in ("prev_id", "next_id")})
    return graph.drop_dangling(broken).select("section_id", "prev_id", "next_id")


def _flat(sections: DataFrame, *more: str) -> DataFrame:
    return sections.select(
        "doc_id", "ord", "section_id", "title", "level", F.array_join("heading_path", " / ").alias("heading_path"), "page_start", "page_end", "text", F.array_join("block_ids", ",").alias("block_ids"), "prev_id", "next_id", *more
    )


def segment_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(segment.by_heading(views.v_turn_blocks(spark, sf_dir)))


def segment_bookmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(segment.by_bookmark(views.v_turn_blocks(spark, sf_dir), views.v_bookmarks(spark, sf_dir), split_level=2))


def segment_token_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(segment.by_token_budget(views.v_line_blocks(spark, sf_dir), 200), "token_count")


def block_page_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = segment.usable_bookmarks(views.v_bookmarks(spark, sf_dir), 2)
    return segment.blocks_in_ranges(views.v_turn_blocks(spark, sf_dir), marks).select("doc_id", "id", "nr")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("section_id", token_count(F.col("text")).cast("long").alias("tokens"))


def concept_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.candidates(_sections(spark, sf_dir)).select("section_id", "rank", "candidate")


def title_case_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("section_id", F.posexplode(concepts.title_case_phrases(F.col("text"))).alias("nr", "phrase"))


def concepts_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.extract_concepts(_sections(spark, sf_dir)).select("doc_id", "position", "slug", "title", F.array_join("section_ids", ",").alias("section_ids"))


def concept_mentions_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


def concept_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.ranked_nodes(concepts.concept_nodes(_merged(spark, sf_dir)))


def concept_mentions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detailed(spark, sf_dir).where(F.col("slug") == CONCEPT).select("slug", "doc_id", "section_id", "section_title", "gloss", "source", "summary")


def section_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.section_concepts(_merged(spark, sf_dir), "src1", "src1.d1")


def concepts_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.concat_ws("|", "section_id", "section_title", "gloss", "source")
    lines = F.array_sort(F.collect_list(F.struct("doc_id", "ord", "section_id", one.alias("line"))))
    return _detailed(spark, sf_dir).groupBy("slug").agg(F.min("title").alias("title"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("mentions"))


def annotated_mention_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detailed(spark, sf_dir).groupBy("slug").agg(F.count_if(F.col("summary") != "").alias("annotated"), F.count(F.lit(1)).alias("mentions"))


def annotation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label twice under one slug: the first title and the first gloss stay."""
    rows = views.v_annotations(spark, sf_dir).where("size(concepts) > 0")
    twice = F.flatten(F.transform("concepts", lambda c: F.array(F.struct(c["slug"].alias("slug"), c["title"].alias("title"), F.lit(" ").alias("gloss")), F.struct(slugify(F.coalesce(c["title"], F.lit(""))).alias("slug"), F.lit("other").alias("title"), F.lit("a \t gloss ").alias("gloss")))))
    return concepts.resolve_annotations(rows.withColumn("concepts", twice), strict=False).select("section_id", F.explode("concepts").alias("c")).select("section_id", "c.slug", "c.title", "c.gloss")


def stale_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with an opinion are made to name sections that are gone."""
    marks = views.v_annotations(spark, sf_dir).withColumn("section_id", F.when(F.col("concepts").isNotNull(), F.concat("section_id", F.lit("-gone"))).otherwise(F.col("section_id")))
    return concepts.live_annotations(marks, _sections(spark, sf_dir)).select("section_id", "summary")


def plan_next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.next_batch(*views.v_plan(spark, sf_dir))


def plan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.progress(*views.v_plan(spark, sf_dir))


def plan_mark_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sections, completed = views.v_plan(spark, sf_dir)
    return plans.mark_read(sections, completed)


def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).groupBy("doc_id").agg(F.min_by("title", "ord").alias("title"), F.count(F.lit(1)).alias("section_count")).orderBy("doc_id")


def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.by_heading(views.v_turn_blocks(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("section_count"))


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _sections(spark, sf_dir).select("doc_id", slugify(F.col("title")).alias("section_id"))
    return validation.duplicate_ids(ids)


def unsafe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _sections(spark, sf_dir).select("doc_id", F.when(F.col("level") == 1, F.col("title")).otherwise(F.col("section_id")).alias("section_id"))
    return validation.unsafe_ids(ids)


def section_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as images: those of the first page have no file, those of long captions lie under images/."""
    blocks = views.v_turn_blocks(spark, sf_dir)
    made = blocks.withColumn("asset_path", F.concat(F.lit("./x/../"), "id", F.lit(".png"))).withColumn("type", F.when(F.col("type") == "text", "image").otherwise(F.col("type")))
    files = made.where("type = 'image' AND page_idx > 0").select("doc_id", F.concat(F.when(F.length("text") > 60, "images/").otherwise(""), "id", F.lit(".png")).alias("path"))
    return assets.section_assets(segment.by_heading(blocks), made, files)


def render_section_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.section_pages(segment.by_heading(views.v_turn_blocks(spark, sf_dir)))


def render_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.outlines(_sections(spark, sf_dir))


def render_concept_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = list_documents(spark, sf_dir).select("doc_id", F.col("title").alias("book_title"))
    return render.concept_pages(_detailed(spark, sf_dir, marked=True), titles)


def bridge_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = segment.by_heading(views.v_turn_blocks(spark, sf_dir))
    before = render.staged_sources(sections.where("level = 2")).select("section_id", F.sha2("content", 256).alias("sha"))
    changed = sections.withColumn("text", F.when(F.col("page_start") == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return render.staged_sources(changed, before).select("section_id", "name", "changed")


def folded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("section_id", F.array_join(terms(F.col("title")), " ").alias("terms"))


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as layout JSON, two turns a page, and read back."""
    turns = views.table(spark, sf_dir, "conversations").withColumn("page", F.floor(F.col("turn") / 2).cast("int"))
    block = F.struct(F.when(F.col("role") == "assistant", "text").when(F.col("role") == "system", "interline_equation").otherwise("title").alias("type"), F.array(F.struct(F.array(F.struct(F.col("text").alias("content"))).alias("spans"))).alias("lines"))
    pages = turns.groupBy("conv_id", "page").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("x"))
    pages = pages.select("conv_id", F.struct(F.col("page").alias("page_idx"), F.transform("x", lambda x: x["b"]).alias("para_blocks")).alias("p"))
    docs = pages.groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(F.to_json(F.struct(F.array_sort(F.collect_list("p")).alias("pdf_info"))).alias("json"))
    return layout.layout_blocks(docs).select("doc_id", "id", "type", "text", "level", "page_idx")


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), "html")
    return html.html_blocks(pages).select("doc_id", "ord", "id", "type", "text", "level")


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(None).cast("string").alias("source_path"))
    return markdown.markdown_blocks(docs).select("doc_id", "ord", "id", "type", "text", "level")


QUERIES = {
    f.__name__: f
    for f in (
        fts_bm25_topk, fts_bm25_scoped, scan_tf_search, search_union_indexed_scan, search_snippet, tokenize_terms, folded_terms, slugify_titles, unique_slugs, section_prev_next, section_outline, section_children, section_related,
        dangling_links, segment_heading, segment_bookmark, segment_token_page, block_page_range_join, token_counts, concept_candidates, title_case_phrases, concepts_top50, concept_mentions_merged, concept_nodes, concept_mentions_of,
        section_concepts, concepts_bulk, annotated_mention_count, annotation_dedup, stale_annotations, plan_next_batch, plan_progress, plan_mark_read, list_documents, catalog_counts, duplicate_ids, unsafe_ids, section_assets,
        render_section_md, render_outline, render_concept_page, bridge_changed, layout_blocks, html_blocks, markdown_blocks,
    )
}
