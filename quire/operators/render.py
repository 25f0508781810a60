"""Markdown renderings as (key, content) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import heading_mark, json_number, json_string, json_strings


def _document(fields: list[tuple[str, Column]]) -> Column:
    """Front matter of JSON values, then the section's heading and text."""
    lines = [F.lit("---"), *(F.concat(F.lit(f"{k}: "), v) for k, v in fields), F.lit("---")]
    body = F.concat(heading_mark(F.col("level")), F.lit(" "), "title", F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit("\n\n"), "text")).otherwise(""))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), body, F.lit("\n"))


def section_markdown() -> Column:
    text, number = (lambda c: json_string(F.col(c))), (lambda c: json_number(F.col(c)))
    return _document([
        ("id", text("section_id")), ("doc_id", text("doc_id")), ("title", text("title")), ("level", number("level")), ("heading_path", json_strings(F.col("heading_path"))),
        ("page_start", number("page_start")), ("page_end", number("page_end")), ("prev_id", text("prev_id")), ("next_id", text("next_id")), ("block_ids", json_strings(F.col("block_ids"))),
    ])


def source_markdown(prefix: str = "quire") -> Column:
    """A section as a source document of its own, with its origin under keys that begin with ``prefix``."""
    text = lambda c: json_string(F.col(c))
    return _document([("title", text("title")), (f"{prefix}_doc_id", text("doc_id")), (f"{prefix}_section_id", text("section_id")), (f"{prefix}_heading_path", json_strings(F.col("heading_path")))])


def section_pages(sections: DataFrame) -> DataFrame:
    """(doc_id, section_id, content)."""
    return sections.select("doc_id", "section_id", section_markdown().alias("content"))


def staged_sources(sections: DataFrame, before: DataFrame | None = None, prefix: str = "quire") -> DataFrame:
    """(doc_id, section_id, name, content, changed): ``changed`` where ``before`` (section_id, sha) lacks the content's SHA-256."""
    now = sections.select("doc_id", "section_id", F.concat("section_id", F.lit(".md")).alias("name"), source_markdown(prefix).alias("content"))
    if before is None:
        return now.withColumn("changed", F.lit(True))
    met = now.join(before.select("section_id", F.col("sha").alias("_sha")), "section_id", "left")
    return met.select("doc_id", "section_id", "name", "content", (~F.sha2("content", 256).eqNullSafe(F.col("_sha"))).alias("changed"))


def _lines(order: list[str], line: Column) -> Column:
    """Lines of a group in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), "\n")


def outlines(sections: DataFrame) -> DataFrame:
    """(doc_id, content): a nested list of each book's sections in reading order."""
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0))), F.lit("- ["), "title", F.lit("](sections/"), "section_id", F.lit(".md)"))
    return sections.groupBy("doc_id").agg(_lines(["ord", "section_id"], line).alias("body")).select("doc_id", F.concat(F.lit("# "), "doc_id", F.lit("\n\n"), "body", F.lit("\n")).alias("content"))


def concept_link() -> Column:
    return F.concat(F.lit("[["), "slug", F.lit("|"), F.replace("title", F.lit("|"), F.lit("/")), F.lit("]]"))


def linked_section_pages(sections: DataFrame, concepts: DataFrame) -> DataFrame:
    """Section pages with links to the concepts (doc_id, slug, title, section_ids) that they mention, by slug."""
    links = concepts.select("doc_id", F.explode("section_ids").alias("section_id"), "slug", concept_link().alias("link")).groupBy("doc_id", "section_id").agg(_lines(["slug"], F.concat(F.lit("- "), "link")).alias("links"))
    linked = F.when(F.col("links").isNotNull(), F.concat(F.lit("\n## Linked concepts\n\n"), "links", F.lit("\n"))).otherwise("")
    return section_pages(sections).join(links, ["doc_id", "section_id"], "left").select("doc_id", "section_id", F.concat("content", linked).alias("content"))


def book_indexes(sections: DataFrame, concepts: DataFrame) -> DataFrame:
    """(doc_id, content): the outline and the book's concepts in rank order."""
    line = F.concat(F.lit("- "), concept_link(), F.lit(" ("), F.size("section_ids").cast("string"), F.lit(" sections)"))
    listed = concepts.groupBy("doc_id").agg(_lines(["position"], line).alias("listed"))
    met = outlines(sections).join(listed, "doc_id", "left")
    return met.select("doc_id", F.concat(F.rtrim(F.regexp_replace("content", r"\s+\z", "")), F.lit("\n\n## Concepts\n\n"), F.coalesce("listed", F.lit("No concepts extracted.")), F.lit("\n")).alias("content"))


def concept_pages(mentions: DataFrame, titles: DataFrame) -> DataFrame:
    """(slug, content): a page per concept with its detailed mentions by book (``titles``: doc_id, book_title) in reading order.

    A concept that is mentioned everywhere makes one page as long as its mentions, as the page lists them all; its
    lines and counts are made per book first.  The mentions are marked ones, so one with several lines counts once.
    """
    suffix = F.concat(F.when(F.col("gloss") != "", F.concat(F.lit(" — "), "gloss")).otherwise(""), F.when(F.col("source") == "agent", " (agent-verified)").otherwise(""))
    line = F.concat(
        F.lit("- ["), "section_title", F.lit("](../books/"), "doc_id", F.lit("/sections/"), "section_id", F.lit(".md)"), suffix, F.when(F.col("summary") != "", F.concat(F.lit("\n  > "), "summary")).otherwise("")
    )
    per_book = mentions.groupBy("slug", "doc_id").agg(_lines(["ord", "section_id"], line).alias("lines"), F.min("title").alias("title"), F.count_if("first").alias("n")).join(titles, "doc_id", "left")
    part = F.concat(F.lit("\n## "), F.coalesce("book_title", "doc_id"), F.lit("\n\n"), "lines")
    whole = per_book.groupBy("slug").agg(_lines(["doc_id"], part).alias("body"), F.min("title").alias("title"), F.count(F.lit(1)).alias("doc_count"), F.sum("n").alias("mention_count"))
    plural = lambda n, word: F.concat(F.col(n).cast("string"), F.when(F.col(n) == 1, f" {word}").otherwise(f" {word}s"))
    head = F.concat(F.lit("# "), "title", F.lit("\n\nMentioned in "), plural("doc_count", "book"), F.lit(" · "), plural("mention_count", "section"), F.lit("."))
    return whole.select("slug", F.concat(head, F.lit("\n"), "body", F.lit("\n")).alias("content"))
