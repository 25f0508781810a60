"""Title, author, pages and bookmarks of PDFs, where a PDF library is installed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from importlib import import_module
from pathlib import Path


@dataclass(frozen=True)
class Bookmark:
    title: str
    page_index: int | None
    level: int


@dataclass(frozen=True)
class PdfMetadata:
    title: str | None = None
    author: str | None = None
    pages: int = 0
    bookmarks: list[Bookmark] = field(default_factory=list)


def _clean(value: object) -> str | None:
    return (str(value).strip() or None) if value is not None else None


def flatten_outline(items: list, page_of: Callable[[object], int | None], level: int = 1) -> Iterator[Bookmark]:
    """Bookmarks in reading order: a list within the outline is one level deeper; untitled ones go."""
    for item in items:
        if isinstance(item, list):
            yield from flatten_outline(item, page_of, level + 1)
        elif title := _clean(getattr(item, "title", None)):
            yield Bookmark(title, page_of(item), level)


def inspect_pdf(path: Path) -> PdfMetadata:
    """What the file says of itself; nothing if there is no library or it can't read the file."""
    try:
        reader = import_module("pypdf").PdfReader(str(path))

        def page_of(item: object) -> int | None:
            try:
                return reader.get_destination_page_number(item)
            except Exception:  # outlines of broken files fail in many ways; the bookmark has no page then
                return None

        about = reader.metadata
        return PdfMetadata(_clean(about.title if about else None), _clean(about.author if about else None), len(reader.pages), list(flatten_outline(list(reader.outline or []), page_of)))
    except Exception:  # also ImportError: registration goes on without metadata
        return PdfMetadata()
