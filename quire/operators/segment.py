"""Segmentation of blocks into sections: by headings, by bookmarks, by a token budget that keeps pages whole.

Blocks are (doc_id, ord, id, type, text, level, page_idx, doc_title) in the order of ``ord``.  All documents are cut at
once; a document's blocks are the unit that windows and folds work in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import slugify, strip, token_count
from quire.operators.fold import fold_ordered


_TEXT_TYPES = ("title", "text", "list", "table", "equation", "unknown")


def _free_names() -> Callable[[object, str], str]:
    """Names of a family's rows in order: the slug itself, else the first of slug-2, slug-3, ... that no row before has."""
    used: set[str] = set()
    following: dict[str, int] = {}

    def name(_: object, slug: str) -> str:
        found = slug
        if slug in used:
            k = following.get(slug, 2)
            while (found := f"{slug}-{k}") in used:
                k += 1
            following[slug] = k + 1
        used.add(found)
        return found

    return name


def unique_slugs(rows: DataFrame, order: str = "nr") -> DataFrame:
    """Adds ``slug`` to (doc_id, ``order``, title): unique in the document, in order.

    The slug of the title, else the first of slug-2, slug-3, ... that no row before has, made-up ones included.  Made-up
    names only meet slugs that are the same without numbers at the end, so each such family is named by itself: by
    counting where it has one slug or none twice, else by a fold.
    """
    named = rows.select("doc_id", F.col(order).alias("_nr"), slugify(F.col("title")).alias("_slug")).withColumn("_family", F.regexp_replace("_slug", r"(-[0-9]+)+$", ""))
    slugs = named.groupBy("doc_id", "_family", "_slug").agg(F.count(F.lit(1)).alias("n"))
    clashing = slugs.groupBy("doc_id", "_family").agg(F.count(F.lit(1)).alias("_slugs"), F.max("n").alias("_most")).where("_slugs > 1 AND _most > 1").select("doc_id", "_family")
    nth = F.row_number().over(Window.partitionBy("doc_id", "_slug").orderBy("_nr"))
    counted = named.join(clashing, ["doc_id", "_family"], "left_anti").withColumn("_nth", nth)
    counted = counted.select("doc_id", "_nr", F.when(F.col("_nth") == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", "_nth")).alias("slug"))
    folded = fold_ordered(named.join(clashing, ["doc_id", "_family"], "left_semi").select("doc_id", "_family", "_nr", "_slug"), ["doc_id", "_family"], ["_nr"], _free_names, "slug", "string")
    both = counted.unionByName(folded.select("doc_id", "_nr", "slug")).withColumnRenamed("_nr", order)
    return rows.join(both, ["doc_id", order])


def _body(include_titles: bool) -> Column:
    """Non-blank block texts in order, a blank line between."""
    kept = (strip(F.coalesce("text", F.lit(""))) != "") & (F.lit(include_titles) | (F.col("type") != "title"))
    texts = F.array_sort(F.collect_list(F.when(kept, F.struct("ord", strip(F.col("text")).alias("text")))))
    return F.array_join(F.transform(texts, lambda x: x["text"]), "\n\n")


def _block_ids() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("ord", "id")))), lambda x: x["id"])


def _finished(sections: DataFrame) -> DataFrame:
    """Names sections and links them in reading order; takes (doc_id, nr, title, ...)."""
    named = unique_slugs(sections).withColumn("section_id", F.concat_ws(".", "doc_id", "slug"))
    order = Window.partitionBy("doc_id").orderBy("nr")
    out = named.withColumns({"prev_id": F.lag("section_id").over(order), "next_id": F.lead("section_id").over(order)})
    return out.select("doc_id", F.col("nr").cast("int").alias("ord"), "section_id", "title", "level", "heading_path", "page_start", "page_end", "text", "block_ids", "prev_id", "next_id")


def by_heading(blocks: DataFrame, target_level: int = 2) -> DataFrame:
    """A section per title of ``target_level`` or above; blocks before any title are front matter.

    A section's path are the titles above it that none of the same or a smaller level has ended; titles deeper than
    the target stay in block_ids but not in the text.  page_end is the page before the next section's first page, even
    if that is before page_start.  There is a running value for each level that the titles have.
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_title = F.col("type") == "title"
    level = F.when(F.coalesce("level", F.lit(0)) == 0, 1).otherwise(F.col("level"))
    levels = sorted(r[0] for r in blocks.where(is_title).select(level).distinct().collect())  # as many rows as titles nest deep
    rows = blocks.withColumns({"_title": is_title, "_level": F.when(is_title, level)}).withColumn("_opens", (F.row_number().over(order) == 1) | (F.col("_title") & (F.col("_level") <= target_level)))
    last = {k: F.last(F.when(F.col("_level") == k, F.struct("ord", "text")), ignorenulls=True).over(upto) for k in levels}
    rows = rows.withColumns({"_nr": F.sum(F.col("_opens").cast("int")).over(upto) - 1} | {f"_h{k}": c for k, c in last.items()})

    def on_path(k: int) -> Column:
        above = [F.col(f"_h{j}").isNull() | (F.col(f"_h{j}.ord") < F.col(f"_h{k}.ord")) for j in levels if j < k]
        kept = F.col(f"_h{k}").isNotNull() & (F.col("_level") >= k)
        for condition in above:
            kept = kept & condition
        return F.when(kept, F.col(f"_h{k}.text"))

    path = F.filter(F.array(*(on_path(k) for k in levels), F.lit(None).cast("string")), lambda t: t.isNotNull())
    front = F.concat(F.col("doc_title"), F.lit(" — Front Matter"))
    head = F.when(
        F.col("_opens"),
        F.struct("ord", F.when(F.col("_title"), F.col("text")).otherwise(front).alias("title"), F.coalesce("_level", F.lit(1)).alias("level"), F.when(F.col("_title"), path).otherwise(F.array(front)).alias("path"), F.col("page_idx").alias("page")),
    )
    sections = rows.withColumn("_head", head).groupBy("doc_id", F.col("_nr").alias("nr")).agg(
        F.min("_head").alias("head"), F.min("page_idx").alias("first"), F.max("page_idx").alias("last"), _body(include_titles=False).alias("text"), _block_ids().alias("block_ids")
    )
    next_start = F.lead("head.page").over(Window.partitionBy("doc_id").orderBy("nr"))
    return _finished(
        sections.select(
            "doc_id", "nr", F.col("head.title").alias("title"), F.col("head.level").alias("level"), F.col("head.path").alias("heading_path"), F.coalesce("first", "head.page").alias("page_start"),
            F.coalesce(next_start - 1, "last").alias("page_end"), "text", "block_ids",
        )
    )


def usable_bookmarks(bookmarks: DataFrame, split_level: int = 1) -> DataFrame:
    """Bookmarks with a page and a level of at most ``split_level``; ``nr`` counts them by page, level and title."""
    order = Window.partitionBy("doc_id").orderBy("page_index", "level", "title", "pos")
    return bookmarks.where(F.col("page_index").isNotNull() & (F.col("level") <= split_level)).withColumn("nr", F.row_number().over(order) - 1)


def blocks_in_ranges(blocks: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Adds ``nr`` of the last bookmark at or before each block's page; blocks before the first, or without page, go.

    An as-of merge: both sides share one window by document instead of a range join.
    """
    marks = bookmarks.select("doc_id", F.col("page_index").alias("_page"), F.lit(0).alias("_kind"), F.col("nr").cast("long").alias("_ord"), F.col("nr").alias("_nr"), F.lit(None).cast(blocks.schema.simpleString()).alias("_block"))
    rows = blocks.where("page_idx IS NOT NULL").select("doc_id", F.col("page_idx").alias("_page"), F.lit(1).alias("_kind"), F.col("ord").cast("long").alias("_ord"), F.lit(None).cast("int").alias("_nr"), F.struct(*blocks.columns).alias("_block"))
    order = Window.partitionBy("doc_id").orderBy("_page", "_kind", "_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = marks.unionByName(rows).withColumn("nr", F.last("_nr", ignorenulls=True).over(order))
    return met.where("_kind = 1 AND nr IS NOT NULL").select("_block.*", "nr")


def by_bookmark(blocks: DataFrame, bookmarks: DataFrame, split_level: int = 1) -> DataFrame:
    """A section per bookmark over the pages up to the next one; documents without usable bookmarks go by headings."""
    usable = usable_bookmarks(bookmarks, split_level)
    body = blocks_in_ranges(blocks, usable).groupBy("doc_id", "nr").agg(F.max("page_idx").alias("last"), _body(include_titles=False).alias("text"), _block_ids().alias("block_ids"))
    docs = blocks.select("doc_id").distinct()
    next_page = F.lead("page_index").over(Window.partitionBy("doc_id").orderBy("nr"))
    marks = usable.join(docs, "doc_id", "left_semi").withColumn("_next", next_page).join(body, ["doc_id", "nr"], "left")
    sections = _finished(
        marks.select(
            "doc_id", "nr", "title", "level", F.array("title").alias("heading_path"), F.col("page_index").alias("page_start"),
            "_next", "last", "page_index", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("block_ids", F.array().cast("array<string>")).alias("block_ids"),
        ).withColumn("page_end", F.when(F.col("_next").isNotNull(), F.greatest("page_index", F.col("_next") - 1)).otherwise(F.col("last")))
    )
    rest = blocks.join(usable.select("doc_id").distinct(), "doc_id", "left_anti").select(*blocks.columns)
    return sections.unionByName(by_heading(rest))


def segmentable(blocks: DataFrame) -> DataFrame:
    """Blocks of text types that aren't blank, and images and charts whatever their text."""
    return blocks.where((F.col("type").isin(*_TEXT_TYPES) & (strip(F.coalesce("text", F.lit(""))) != "")) | F.col("type").isin("image", "chart"))


def by_token_budget(blocks: DataFrame, max_tokens: int = 800) -> DataFrame:
    """Parts of at most ``max_tokens`` white-space tokens that never split a page; a larger page is a part of its own.

    Only tokens are windowed, summed by page and folded into parts; texts meet the first block of each part by an as-of
    merge, so they move once.  Blocks without a page are pages of their own.
    """
    if max_tokens < 1:
        raise ValueError("max_tokens must be at least 1")
    order = Window.partitionBy("doc_id").orderBy("ord")
    page, before = F.col("page_idx"), F.lag("page_idx").over(order)
    starts = F.when(page.isNull() | before.isNull() | (page != before), 1).otherwise(0)
    kept = segmentable(blocks).withColumn("tokens", token_count(F.coalesce("text", F.lit(""))))
    rows = kept.select("doc_id", F.col("ord").cast("long").alias("ord"), "page_idx", "tokens").withColumn("_starts", starts)
    rows = rows.withColumn("g", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    pages = rows.groupBy("doc_id", "g").agg(F.min("ord").alias("ord"), F.sum("tokens").alias("n"))

    def parts() -> Callable[[int, int, int], int]:
        held = [0, 0]  # the part, and its tokens so far

        def part_of(g: int, ord_: int, n: int) -> int:
            held[:] = [held[0], held[1] + n] if held[0] and held[1] + n <= max_tokens else [held[0] + 1, n]
            return held[0]

        return part_of

    first = fold_ordered(pages.select("doc_id", "g", "ord", "n"), ["doc_id"], ["g"], parts, "part", "int").groupBy("doc_id", "part").agg(F.min("ord").alias("_ord"))
    first = first.select("doc_id", "_ord", F.lit(0).alias("_kind"), "part", F.lit(None).cast(kept.schema.simpleString()).alias("_block"))
    merged = first.unionByName(kept.select("doc_id", F.col("ord").cast("long").alias("_ord"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("part"), F.struct(*kept.columns).alias("_block")))
    upto = Window.partitionBy("doc_id").orderBy("_ord", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = merged.withColumn("_part", F.last("part", ignorenulls=True).over(upto)).where("_kind = 1").select("_block.*", F.col("_part").alias("part"))
    cut = met.groupBy("doc_id", "part").agg(
        F.first("doc_title").alias("doc_title"), F.min("page_idx").alias("page_start"), F.max("page_idx").alias("page_end"), _body(include_titles=True).alias("text"), _block_ids().alias("block_ids"), F.sum("tokens").alias("token_count")
    )
    reading = Window.partitionBy("doc_id").orderBy("part")
    name = F.concat(F.col("doc_id"), F.lit(".part-"), F.col("part").cast("string"))
    title = F.concat(F.col("doc_title"), F.lit(" — Part "), F.col("part").cast("string"))
    out = cut.withColumns({"section_id": name, "title": title})
    return out.select(
        "doc_id", (F.col("part") - 1).alias("ord"), "section_id", "title", F.lit(1).alias("level"), F.array("title").alias("heading_path"), "page_start", "page_end", "text", "block_ids",
        F.lag("section_id").over(reading).alias("prev_id"), F.lead("section_id").over(reading).alias("next_id"), "token_count",
    )
