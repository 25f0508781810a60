"""Files of other formats to blocks: CSV as tables, plain text as Markdown, HTML; office formats where a converter is installed."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from importlib import import_module

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.html import page_blocks
from quire.sources.markdown import blocks_of

FROM_BYTES = frozenset({"doc", "docx", "epub", "ppt", "pptx", "xls", "xlsx"})


#: module:class of the converter to Markdown, a public package with ``convert_stream``; others can be named here.
CONVERTER = "markitdown:MarkItDown"


class MissingConverterError(RuntimeError):
    """An office format, and no converter is installed."""


def _converter():
    """A converter with ``convert_stream``, by the module's and class's name in ``CONVERTER``."""
    module, name = CONVERTER.split(":")
    try:
        return getattr(import_module(module), name)()
    except ImportError as problem:
        raise MissingConverterError(f"{module}, which converts office formats, is not installed") from problem


def file_blocks(ending: str, data: bytes) -> list[tuple[str, str, int | None, str | None]]:
    """(type, text, level, src) of one file by its ending."""
    if ending in FROM_BYTES:
        text = _converter().convert_stream(io.BytesIO(data), file_extension=f".{ending}").text_content
        return [(b.type, b.text, b.level, b.metadata.get("src")) for b in blocks_of(text)]
    text = data.decode("utf-8-sig", "replace")
    if ending in ("htm", "html"):
        return page_blocks(text)
    if ending == "csv":
        rows = [" | ".join(c.strip() for c in row) for row in csv.reader(io.StringIO(text)) if any(c.strip() for c in row)]
        return [("table", "\n".join(rows), None, None)] if rows else []
    return [(b.type, b.text, b.level, b.metadata.get("src")) for b in blocks_of(text)]


def converted_blocks(sources: DataFrame) -> DataFrame:
    """Blocks (doc_id, ord, id, type, text, level, asset_path) of ``sources`` (doc_id, path, content as in binaryFile)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, ending, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(doc_id, i, f"b{i}", *b) for i, b in enumerate(file_blocks(ending, data or b""))]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "ord", "id", "type", "text", "level", "asset_path"])

    ending = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return sources.select(F.col("doc_id").cast("string"), ending.alias("ending"), "content").mapInArrow(each, "doc_id string, ord int, id string, type string, text string, level int, asset_path string")
