"""HTML pages to blocks: headings, paragraphs, list items, quotes, preformatted text, tables and images."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TYPES = {"p": "text", "li": "list", "blockquote": "text", "pre": "text", "tr": "table"} | {f"h{k}": "title" for k in range(1, 7)}
_SKIPPED = {"script", "style", "template", "noscript", "head"}


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str, int | None, str | None]] = []
        self.tag, self.parts, self.cells, self.hidden = "", [], [], 0

    def end_block(self) -> None:
        if self.tag == "tr":
            self.cells.append(" ".join("".join(self.parts).split()))
            text = " | ".join(c for c in self.cells if c)
        else:
            text = " ".join("".join(self.parts).split())
        if text:
            self.rows.append((_TYPES.get(self.tag, "text"), text, int(self.tag[1]) if self.tag[:1] == "h" and self.tag[1:].isdigit() else None, None))
        self.tag, self.parts, self.cells = "", [], []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SKIPPED:
            self.hidden += 1
        elif tag == "img":
            found = dict(attrs)
            self.end_block()
            self.rows.append(("image", found.get("alt") or "", None, found.get("src") or ""))
        elif tag in ("td", "th") and self.tag == "tr":
            self.cells.append(" ".join("".join(self.parts).split()))
            self.parts = []
        elif tag in _TYPES or tag in ("div", "article", "section", "ul", "ol", "table", "nav", "footer", "header", "main", "aside"):
            self.end_block()
            self.tag = tag if tag in _TYPES else ""
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED:
            self.hidden = max(self.hidden - 1, 0)
        elif tag in _TYPES or tag in ("div", "article", "section", "nav", "footer", "header", "main", "aside"):
            self.end_block()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def page_blocks(html: str) -> list[tuple[str, str, int | None, str | None]]:
    """(type, text, level, src) in page order."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.end_block()
    return parser.rows


def html_blocks(pages: DataFrame) -> DataFrame:
    """Blocks (doc_id, ord, id, type, text, level, page_idx, asset_path) of ``pages`` (doc_id, html); null html has none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, i, f"b{i}", t, x, level, src) for d, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, (t, x, level, src) in enumerate(page_blocks(html or ""))]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "ord", "id", "type", "text", "level", "asset_path"])

    return pages.select(F.col("doc_id").cast("string"), "html").mapInArrow(each, "doc_id string, ord int, id string, type string, text string, level int, asset_path string")
