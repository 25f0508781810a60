"""Command line: ``python -m quire.plans.cli <workspace> <command> ...``."""

from __future__ import annotations

import argparse
import json
import re
import shlex
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import doc_id_from_name
from quire.plans import plugins
from quire.plans.service import NotFoundError, ReadingService, checked_id
from quire.plans.tools import Tools
from quire.plans.workspace import Workspace, load_config
from quire.sources.external import TIMEOUT_SECONDS, resolve_options, run_parser
from quire.sources.pages import compile_books, compile_concepts, register_book, stage_sources
from quire.sources.readers import read_bookmarks
from quire.sources.routing import parser_for

BOOKMARKS = "doc_id string, pos int, title string, page_index int, level int"


def slug_of(name: str) -> str:
    return re.sub("[^a-z0-9]+", "-", name.lower()).strip("-") or "untitled"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quire")
    out.add_argument("workspace", type=Path)
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("init")
    commands.add_parser("paths")
    commands.add_parser("parsers")
    parse = commands.add_parser("parse")
    parse.add_argument("source")
    parse.add_argument("--parser")
    parse.add_argument("--doc-id")
    cut = commands.add_parser("segment")
    cut.add_argument("--segmenter")
    cut.add_argument("--target-level", type=int)
    cut.add_argument("--max-tokens", type=int)
    cut.add_argument("--bookmarks", help="book manifests; those of the inbox by default")
    cut.add_argument("--doc-id", action="append")
    add = commands.add_parser("add-book")
    add.add_argument("pdf", type=Path)
    add.add_argument("--book-id")
    add.add_argument("--title")
    book = commands.add_parser("parse-book")
    book.add_argument("book_id")
    book.add_argument("--command", dest="program", required=True, help="the external layout parser")
    book.add_argument("--profile")
    book.add_argument("--start-page", type=int)
    book.add_argument("--end-page", type=int)
    book.add_argument("--timeout", type=float, default=TIMEOUT_SECONDS)
    compile_ = commands.add_parser("compile")
    compile_.add_argument("--doc-id", action="append")
    compile_.add_argument("--plain", action="store_true", help="without links to concepts")
    concept_pages = commands.add_parser("index-concepts")
    stage = commands.add_parser("stage")
    stage.add_argument("folder")
    stage.add_argument("--completed-in", help="only sections that this plan has marked as read")
    for one in (parse, cut, add, book, compile_, concept_pages, stage):
        one.add_argument("--dry-run", action="store_true", help="say what would be done")
    tool = commands.add_parser("tool")
    tool.add_argument("name")
    tool.add_argument("arguments", nargs="?", default="{}", help="a JSON object")
    index = commands.add_parser("index")
    index.add_argument("--doc-id", action="append")
    commands.add_parser("documents")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--doc-id")
    search.add_argument("--limit", type=int)
    for name, *more in (("outline", "doc_id"), ("section", "doc_id", "section_id"), ("related", "doc_id", "section_id"), ("concept", "slug"), ("next", "plan_id"), ("plans",)):
        one = commands.add_parser(name)
        for m in more:
            one.add_argument(m)
    plan = commands.add_parser("plan")
    plan.add_argument("doc_id")
    plan.add_argument("--plan-id")
    plan.add_argument("--daily", type=int)
    plan.add_argument("--overwrite", action="store_true")
    mark = commands.add_parser("mark-read")
    mark.add_argument("plan_id")
    mark.add_argument("--section-id")
    return out


def parsed_blocks(spark: SparkSession, source: str, parser_name: str | None = None, doc_id: str | None = None) -> DataFrame:
    """Blocks of the files at ``source`` (a path or glob)."""
    name = parser_name or parser_for(source)
    files = spark.read.format("binaryFile").load(source).select("path", "content", F.decode("content", "utf-8").alias("text"), F.col("path").alias("source_path"))
    files = files.withColumn("doc_id", F.lit(doc_id) if doc_id else doc_id_from_name(F.url_decode("path")))
    rows = {"html": files.withColumnRenamed("text", "html"), "layout-json": files.withColumnRenamed("text", "json")}.get(name, files)
    blocks = plugins.parsers().get(name)(rows)
    title = blocks.where((F.col("type") == "title") & (F.col("level") == 1)).groupBy("doc_id").agg(F.min_by("text", "ord").alias("doc_title"))
    return blocks.join(title, "doc_id", "left").withColumn("doc_title", F.coalesce("doc_title", "doc_id"))


def checked_pages(start: int | None, end: int | None, pages: int = 0) -> None:
    """Raises for a range of pages, counted from 0, that isn't one or is beyond the ``pages`` that a book has (0: unknown)."""
    if (start or 0) < 0 or (end is not None and end < (start or 0)):
        raise ValueError(f"pages {start} to {end} are no range")
    if pages and max(start or 0, end or 0) >= pages:
        raise ValueError(f"the book has pages 0 to {pages - 1}")


def parse_book(workspace: Workspace, args: argparse.Namespace) -> Path:
    """Runs the external parser on a registered book; returns its layout JSON."""
    folder = workspace.root / "inbox" / checked_id(args.book_id, "book")
    if not (folder / "book.json").exists():
        raise NotFoundError(f"no book {args.book_id!r} is registered")
    checked_pages(args.start_page, args.end_page, json.loads((folder / "book.json").read_text())["pdf"]["pages"])
    options = resolve_options(args.profile, start_page=args.start_page, end_page=args.end_page)
    return run_parser(shlex.split(args.program), folder / "original.pdf", workspace.root / "runs" / args.book_id, options, args.timeout)


def missing_pages(spark: SparkSession, folder: Path, mentions: DataFrame) -> DataFrame:
    """(doc_id, section_id) that concept pages link to and that have no compiled page yet."""
    listed = [(p.parent.parent.name, p.stem) for p in folder.glob("*/sections/*.md")]
    there = spark.createDataFrame(listed, "doc_id string, section_id string")
    return mentions.select("doc_id", "section_id").distinct().join(there, ["doc_id", "section_id"], "left_anti")


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    workspace = Workspace(args.workspace)
    if getattr(args, "dry_run", False):
        print(json.dumps({k: str(v) if isinstance(v, Path) else v for k, v in vars(args).items() if v not in (None, False)}))
        return 0
    if args.command == "init":
        workspace.create()
        return 0
    if args.command == "paths":
        print(json.dumps([str(p) for p in workspace.directories()]))
        return 0
    if args.command == "parsers":
        print("\n".join(plugins.parsers().names()))
        return 0
    if args.command == "add-book":
        book_id = checked_id(args.book_id or slug_of(args.pdf.stem), "book")
        print(register_book(args.pdf, args.workspace / "inbox", book_id, args.title or args.pdf.stem))
        return 0
    config = load_config(workspace)
    spark = spark or SparkSession.builder.appName("quire").getOrCreate()
    service = ReadingService(spark, str(args.workspace))
    out: DataFrame | None = None
    match args.command:
        case "parse":
            service.save_blocks(parsed_blocks(spark, args.source, args.parser, args.doc_id))
        case "segment":
            name = args.segmenter or config.segmenter
            more = {"heading": {"target_level": args.target_level or config.target_level}, "token-page": {"max_tokens": args.max_tokens or config.max_tokens}}.get(name, {})
            blocks = service.blocks() if args.doc_id is None else service.blocks().where(F.col("doc_id").isin(args.doc_id))
            if name == "bookmark":
                registered = args.bookmarks or any((args.workspace / "inbox").glob("*/book.json"))
                path = args.bookmarks or str(args.workspace / "inbox/*/book.json")
                more = {"bookmarks": read_bookmarks(spark, path) if registered else spark.createDataFrame([], BOOKMARKS)}
            service.save_sections(plugins.segmenters().get(name)(blocks, **more))
        case "parse-book":
            service.save_blocks(parsed_blocks(spark, str(parse_book(workspace, args)), "layout-json", args.book_id))
        case "compile":
            sections = service.sections() if args.doc_id is None else service.sections().where(F.col("doc_id").isin(args.doc_id))
            print(json.dumps(compile_books(sections, str(args.workspace / "pages/books"), linked=not args.plain)))
        case "index-concepts":
            mentions, titles = service.index.table("mentions"), service.index.catalog().select("doc_id", F.col("title").alias("book_title"))
            written = compile_concepts(mentions, service.sections(), service.index.table("annotations"), titles, str(args.workspace / "pages/concepts"))
            print(json.dumps(written | {"links_without_page": missing_pages(spark, args.workspace / "pages/books", mentions).count()}))
        case "stage":
            done = None if args.completed_in is None else service.completed(args.completed_in)
            print(json.dumps(stage_sources(service.sections(), args.folder, done)))
        case "tool":
            print(json.dumps(Tools(spark, str(args.workspace)).call(args.name, **json.loads(args.arguments))))
        case "index":
            print(service.build_index(args.doc_id))
        case "documents":
            out = service.list_documents()
        case "search":
            out = service.search(args.query, args.doc_id, args.limit or config.limit)
        case "outline":
            out = service.get_outline(args.doc_id)
        case "section":
            out = service.get_section(args.doc_id, args.section_id)
        case "related":
            out = service.get_related(args.doc_id, args.section_id)
        case "concept":
            out = service.get_concept(args.slug)["mentions"]
        case "plan":
            out = service.create_plan(args.doc_id, args.plan_id, args.daily or config.daily_sections, args.overwrite)
        case "next":
            out = service.get_next_section(args.plan_id)
        case "mark-read":
            out = service.mark_read(args.plan_id, args.section_id)
        case "plans":
            out = service.list_plans()
    if out is not None:
        for line in out.toJSON().toLocalIterator():
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
