"""Named parts that callers can add to: parsers (rows to blocks), segmenters (blocks to sections), sinks (sections to pages)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from quire.operators import render, segment
from quire.sources import converted, html, layout, markdown


class Registry:
    def __init__(self) -> None:
        self._parts: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, part: Callable[..., DataFrame]) -> None:
        if name in self._parts:
            raise ValueError(f"{name!r} is registered already")
        self._parts[name] = part

    def get(self, name: str) -> Callable[..., DataFrame]:
        if name not in self._parts:
            raise KeyError(f"{name!r} is none of {', '.join(self.names())}")
        return self._parts[name]

    def names(self) -> list[str]:
        return sorted(self._parts)

    def all(self) -> Iterable[Callable[..., DataFrame]]:
        return self._parts.values()


def _registry(**parts: Callable[..., DataFrame]) -> Registry:
    out = Registry()
    for name, part in parts.items():
        out.register(name.replace("_", "-"), part)
    return out


def parsers() -> Registry:
    return _registry(markdown=markdown.markdown_blocks, layout_json=layout.layout_blocks, html=html.html_blocks, converted=converted.converted_blocks)


def segmenters() -> Registry:
    return _registry(heading=segment.by_heading, bookmark=segment.by_bookmark, token_page=segment.by_token_budget)


def sinks() -> Registry:
    return _registry(sections=render.section_pages, linked=render.linked_section_pages)
