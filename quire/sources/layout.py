"""Page-layout JSON (``pdf_info`` pages of nested ``para_blocks``) to blocks.

Pages and blocks are exploded by Spark; only a block's nested content, of any depth, is walked in Python, and only its
text and asset come back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSET_TYPES = frozenset({"image", "table", "chart"})
#: One page: its blocks stay JSON text.
PAGES = "struct<pdf_info:array<struct<page_idx:int,para_blocks:array<string>>>>"


class UnsupportedSourceError(ValueError):
    """An input that the chosen parser can't read."""


def block_text(block: dict) -> str:
    """Own content, then that of its lines' spans, then of its inner blocks; trimmed, blanks dropped, joined by spaces."""
    found = [block.get("content")]
    found += [span.get("content") for line in block.get("lines") or [] for span in line.get("spans") or []]
    found += [block_text(inner) for inner in block.get("blocks") or []]
    return " ".join(x for x in (str(x).strip() for x in found if x) if x)


def block_asset(block: dict) -> str | None:
    """The first image path of a span that is itself an asset, own lines before inner blocks."""
    own = (str(span["image_path"]) for line in block.get("lines") or [] for span in line.get("spans") or [] if span.get("type") in ASSET_TYPES and span.get("image_path"))
    inner = (path for child in block.get("blocks") or [] if (path := block_asset(child)))
    return next(own, None) or next(inner, None)


def layout_blocks(sources: DataFrame) -> DataFrame:
    """Blocks (doc_id, ord, id, type, text, level, page_idx, bbox, asset_path) of ``sources`` (doc_id, json).

    A source that isn't JSON with a list ``pdf_info`` fails the query with the document's id.
    """
    parsed = F.from_json("json", PAGES)
    checked = F.when(F.get_json_object("json", "$.pdf_info").rlike(r"^\s*\["), parsed["pdf_info"]).otherwise(F.raise_error(F.concat(F.lit("no layout JSON with a pdf_info list: "), "doc_id")).cast("array<struct<page_idx:int,para_blocks:array<string>>>"))
    pages = sources.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(checked).alias("_page", "page"))
    blocks = pages.select("doc_id", "_page", F.coalesce("page.page_idx", "_page").alias("page_idx"), F.posexplode("page.para_blocks").alias("_nr", "raw"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.loads(x) for x in batch.column(4).to_pylist()]
            found = [x if isinstance(x, dict) else {} for x in found]
            boxes = [[float(v) for v in x["bbox"]] if isinstance(x.get("bbox"), list) and len(x["bbox"]) == 4 else None for x in found]
            arrays = [pa.array([str(x.get("type") or "") for x in found]), pa.array([block_text(x) for x in found], pa.string()), pa.array(boxes, pa.list_(pa.float64())), pa.array([block_asset(x) for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *arrays], ["doc_id", "_page", "page_idx", "_nr", "kind", "text", "bbox", "asset_path"])

    walked = blocks.mapInArrow(walk, "doc_id string, _page int, page_idx int, _nr int, kind string, text string, bbox array<double>, asset_path string")
    kind = F.when(F.col("kind").isin("title", "text", "list", "table", "image", "chart"), F.col("kind")).when(F.col("kind") == "interline_equation", "equation").otherwise("unknown")
    return walked.select(
        "doc_id", (F.col("_page").cast("long") * 1_000_000 + F.col("_nr")).alias("ord"), F.concat(F.lit("p"), F.col("page_idx").cast("string"), F.lit(".b"), F.col("_nr").cast("string")).alias("id"), kind.alias("type"), "text",
        F.when(kind == "title", 1).alias("level"), "page_idx", "bbox", "asset_path",
    )
