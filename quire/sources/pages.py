"""Sinks that write rendered pages as files, and the register of books.

Pages are written by the executors, each into the shared folder it names; a page whose content is there already is not
touched, so that readers that look at file times see only what has changed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import concepts, render
from quire.sources.outline import PdfMetadata, inspect_pdf


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_pages(pages: DataFrame, folder: str, replace: bool = False) -> dict[str, int]:
    """Writes ``pages`` (name, content) under ``folder``; returns how many were written and how many were the same.

    With ``replace`` the folder is emptied first; else pages of names that are gone stay.
    """
    files, root = _open(folder)
    if replace and files.get_file_info(root).type != fs.FileType.NotFound:
        files.delete_dir(root)
    files.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        for batch in batches:
            changed = []
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path, data = f"{root}/{name}", content.encode()
                there = files.get_file_info(path)
                same = False
                if there.is_file and there.size == len(data):
                    with files.open_input_stream(path) as old:
                        same = hashlib.sha256(old.read()).digest() == hashlib.sha256(data).digest()
                if not same:
                    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    with files.open_output_stream(path) as out:
                        out.write(data)
                changed.append(not same)
            yield pa.RecordBatch.from_arrays([pa.array(changed, pa.bool_())], ["changed"])

    found = pages.select("name", "content").mapInArrow(write, "changed boolean").groupBy("changed").count().collect()
    counts = {r["changed"]: r["count"] for r in found}
    return {"written": counts.get(True, 0), "unchanged": counts.get(False, 0)}


def clear_folders(names: DataFrame, folder: str) -> None:
    """Deletes the folders ``names`` (name) under ``folder``, each by the task that holds its name."""

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if files.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                    files.delete_dir(f"{root}/{name}")
            yield batch

    names.select("name").distinct().mapInArrow(clear, "name string").write.format("noop").mode("overwrite").save()


def compile_books(sections: DataFrame, folder: str, linked: bool = False) -> dict[str, int]:
    """A folder per book: a page per section and an index; ``linked`` adds concept links and replaces the books' sections.

    Books that ``sections`` has no row of stay as they are.
    """
    found = concepts.extract_concepts(sections) if linked else None
    pages = render.linked_section_pages(sections, found) if linked else render.section_pages(sections)
    index = render.book_indexes(sections, found) if linked else render.outlines(sections)
    rows = pages.select(F.concat("doc_id", F.lit("/sections/"), "section_id", F.lit(".md")).alias("name"), "content")
    if linked:
        clear_folders(sections.select(F.concat("doc_id", F.lit("/sections")).alias("name")), folder)
    return write_pages(rows.unionByName(index.select(F.concat("doc_id", F.lit("/README.md")).alias("name"), "content")), folder)


def compile_concepts(mentions: DataFrame, sections: DataFrame, annotations: DataFrame, titles: DataFrame, folder: str) -> dict[str, int]:
    """A page per concept over all books, rewritten whole."""
    detailed = concepts.detailed_mentions(mentions, sections, annotations, marked=True)
    pages = render.concept_pages(detailed, titles)
    return write_pages(pages.select(F.concat("slug", F.lit(".md")).alias("name"), "content"), folder, replace=True)


def stage_sources(sections: DataFrame, folder: str, completed: DataFrame | None = None) -> dict[str, int]:
    """Sections as source documents of their own; only those in ``completed`` (section_id) if it is given."""
    own = sections if completed is None else sections.join(completed.select("section_id").distinct(), "section_id", "left_semi").select(*sections.columns)
    return write_pages(render.staged_sources(own).select("name", "content"), folder)


def register_book(source: Path, inbox: Path, book_id: str, title: str, metadata: PdfMetadata | None = None) -> Path:
    """Copies a PDF to ``inbox/<book_id>`` with a manifest of its metadata and bookmarks; returns the manifest."""
    if source.suffix.lower() != ".pdf":
        raise ValueError(f"{source.name} is no PDF")
    found = metadata or inspect_pdf(source)
    folder = inbox / book_id
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "original.pdf").write_bytes(source.read_bytes())
    marks = [{"title": b.title, "page_index": b.page_index, "level": b.level} for b in found.bookmarks]
    manifest = {"book_id": book_id, "title": title, "source_type": "pdf", "source_path": str(source), "status": "registered", "pdf": {"title": found.title, "author": found.author, "pages": found.pages, "has_bookmarks": bool(marks), "bookmarks": marks}}
    (folder / "book.json").write_text(json.dumps(manifest, indent=2) + "\n")
    return folder / "book.json"
