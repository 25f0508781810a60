"""Markdown to blocks: a line grammar of headings, paragraphs, lists, tables, quotes, code, equations and HTML.

``blocks_of`` cuts one text; ``markdown_blocks`` cuts a table of texts, one Arrow batch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = "doc_id string, ord int, id string, type string, text string, level int, page_idx int, source_path string, metadata map<string,string>"

_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})[ \t]*([^`]*)$")
_ITEM = re.compile(r"^([ \t]*)([-*+]|\d{1,9}[.)])(?:([ \t]+)(.*))?$")
_QUOTE = re.compile(r"^ {0,3}> ?(.*)$")
_HTML = re.compile(r"^ {0,3}<(?:!--|[?!]|/?[a-zA-Z][a-zA-Z0-9-]*(?:[\s/>]|$))")
_DELIMITER = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_IMAGE = re.compile(r"^!\[((?:[^\[\]]|\[[^\]]*\])*)\]\(\s*<?([^\s)>]*)>?(?:\s+[\"'(][^)]*)?\s*\)$")


@dataclass
class Block:
    type: str
    text: str
    first: int  # lines, from 1
    last: int
    level: int | None = None
    metadata: dict[str, str] = field(default_factory=dict)


def _cells(row: str) -> list[str]:
    row = row.strip().removeprefix("|")
    row = row[:-1] if row.endswith("|") and not row.endswith("\\|") else row
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", row)]


def _list_text(lines: list[str]) -> str:
    """Items with two spaces a depth, '-' or their running number."""
    out: list[str] = []
    stack: list[list] = []  # [indent of the marker, indent of its text, ordered, number]
    for line in lines:
        if not line.strip():
            continue
        item, indent = _ITEM.match(line.expandtabs(4)), len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())
        if item and not (stack and indent >= stack[-1][1] + 4):
            while stack and indent < stack[-1][0]:
                stack.pop()
            ordered = item[2][0].isdigit()
            if stack and indent < stack[-1][1] and stack[-1][2] == ordered:
                stack[-1][0], stack[-1][1], stack[-1][3] = indent, indent + len(item[2]) + 1, stack[-1][3] + 1
            elif stack and indent < stack[-1][1]:
                stack[-1] = [indent, indent + len(item[2]) + 1, ordered, int(item[2][:-1]) if ordered else 1]
            else:
                stack.append([indent, indent + len(item[2]) + 1, ordered, int(item[2][:-1]) if ordered else 1])
            if item[4] and item[4].strip():
                out.append(f"{'  ' * (len(stack) - 1)}{f'{stack[-1][3]}.' if ordered else '-'} {item[4].strip()}")
        elif out:
            while len(stack) > 1 and indent < stack[-1][1]:
                stack.pop()
            out.append(f"{'  ' * (len(stack) - 1)}  {line.strip()}")
    return "\n".join(out)


def blocks_of(text: str) -> list[Block]:
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out: list[Block] = []
    i, n = 0, len(lines)

    def starts_block(at: int) -> bool:
        line = lines[at]
        return bool(not line.strip() or _HEADING.match(line) or _FENCE.match(line) or _RULE.match(line) or _QUOTE.match(line) or line.lstrip().startswith("$$") or (_ITEM.match(line) and re.match(r"^ {0,3}(?:[-*+]|1[.)])[ \t]+\S", line)))

    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif fence := _FENCE.match(line):
            end = next((k for k in range(i + 1, n) if re.match(rf"^ {{0,3}}{re.escape(fence[2][0])}{{{len(fence[2])},}}[ \t]*$", lines[k])), n)
            out.append(Block("text", "\n".join(lines[i + 1 : end]).strip("\n"), i + 1, min(end + 1, n), metadata={"code": "true"} | ({"language": fence[3].strip()} if fence[3].strip() else {})))
            i = end + 1
        elif line.startswith(("    ", "\t")):
            end = i
            while end < n and (lines[end].startswith(("    ", "\t")) or not lines[end].strip()):
                end += 1
            while not lines[end - 1].strip():
                end -= 1
            out.append(Block("text", "\n".join(x[1:] if x.startswith("\t") else x[4:] for x in lines[i:end]).strip("\n"), i + 1, end, metadata={"code": "true"}))
            i = end
        elif line.lstrip().startswith("$$"):
            body = line.strip()[2:]
            if body.endswith("$$"):
                out.append(Block("equation", body[:-2].strip(), i + 1, i + 1))
                i += 1
            else:
                end = next((k for k in range(i + 1, n) if lines[k].rstrip().endswith("$$")), n - 1)
                out.append(Block("equation", "\n".join([body, *lines[i + 1 : end], lines[end].rstrip().removesuffix("$$") if end > i else ""]).strip(), i + 1, end + 1))
                i = end + 1
        elif heading := _HEADING.match(line):
            out.append(Block("title", (heading[2] or "").strip(), i + 1, i + 1, level=len(heading[1])))
            i += 1
        elif _RULE.match(line):
            i += 1
        elif _QUOTE.match(line):
            end, inner = i, []
            while end < n and (quote := _QUOTE.match(lines[end]) or (lines[end].strip() and not starts_block(end))):
                inner.append(quote[1] if isinstance(quote, re.Match) else lines[end])
                end += 1
            parts = [x.text for x in blocks_of("\n".join(inner))]
            out.append(Block("text", "\n\n".join(parts), i + 1, end, metadata={"quote": "true"}))
            i = end
        elif _ITEM.match(line):
            indent, end = len(line) - len(line.lstrip()), i + 1
            while end < n:
                if not lines[end].strip():
                    following = next((k for k in range(end, n) if lines[k].strip()), n)
                    if following == n or not (_ITEM.match(lines[following]) or len(lines[following]) - len(lines[following].lstrip()) > indent + 1):
                        break
                elif not _ITEM.match(lines[end]) and not lines[end].startswith((" ", "\t")) and starts_block(end):
                    break
                end += 1
            text_ = _list_text(lines[i:end])
            out.append(Block("list", text_, i + 1, min(end + 1, n) if end < n and not lines[end].strip() else end))
            i = end
        elif _HTML.match(line):
            end = next((k for k in range(i, n) if not lines[k].strip()), n)
            out.append(Block("unknown", "\n".join(lines[i:end]).strip(), i + 1, end))
            i = end
        elif "|" in line and i + 1 < n and "-" in lines[i + 1] and _DELIMITER.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            end = i + 2
            while end < n and lines[end].strip() and not starts_block(end):
                end += 1
            width = len(_cells(line))
            rows = [_cells(line), *((_cells(x) + [""] * width)[:width] for x in lines[i + 2 : end])]
            out.append(Block("table", "\n".join(" | ".join(r) for r in rows), i + 1, end))
            i = end
        else:
            end = i + 1
            while end < n and not starts_block(end) and not _UNDERLINE.match(lines[end]):
                end += 1
            body = "\n".join(x.strip() for x in lines[i:end])
            if end < n and (under := _UNDERLINE.match(lines[end])):
                out.append(Block("title", body, i + 1, end + 1, level=1 if under[1][0] == "=" else 2))
                end += 1
            elif image := _IMAGE.match(body):
                out.append(Block("image", image[1], i + 1, end, metadata={"src": image[2]}))
            else:
                out.append(Block("text", body, i + 1, end))
            i = end
    return out


def document_title(blocks: list[Block]) -> str | None:
    return next((b.text for b in blocks if b.type == "title" and b.level == 1), None)


def markdown_blocks(texts: DataFrame) -> DataFrame:
    """Blocks of every row of ``texts`` (doc_id, text, source_path); null text has none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for ord_, b in enumerate(blocks_of(text or "")):
                    meta = {"line_start": str(b.first), "line_end": str(b.last)} | b.metadata
                    rows.append((doc_id, ord_, f"b{ord_}", b.type, b.text, b.level, None, path, list(meta.items())))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()))
            names = ("doc_id", "ord", "id", "type", "text", "level", "page_idx", "source_path", "metadata")
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], list(names))

    return texts.select(F.col("doc_id").cast("string"), "text", F.col("source_path").cast("string")).mapInArrow(each, BLOCKS)
