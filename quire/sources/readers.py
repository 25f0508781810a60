"""Readers and writers of the interchange files, with explicit schemas: JSON documents, JSONL sections, annotations, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import is_slug_id, strip

BLOCK = "struct<id:string,type:string,text:string,level:int,page_idx:int,bbox:array<double>,asset_path:string,source_path:string,order:int,metadata:map<string,string>>"
DOCUMENT = f"doc_id string, title string, blocks array<{BLOCK}>, metadata map<string,string>"
SECTION = "id string, doc_id string, title string, level int, heading_path array<string>, page_start int, page_end int, text string, prev_id string, next_id string, block_ids array<string>, metadata map<string,string>"
ANNOTATION = "doc_id string, section_id string, concepts array<struct<slug:string,title:string,gloss:string>>, summary string, model string, created_at string"
MANIFEST = "book_id string, title string, source_type string, source_path string, pdf struct<title:string,author:string,pages:int,bookmarks:array<struct<title:string,page_index:string,level:string>>>"


def read_documents(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Blocks (doc_id, doc_title, ord, id, type, ...) of JSON documents, one a file or, as ``write_documents`` has them, one a line."""
    docs = spark.read.schema(DOCUMENT).json(path, multiLine=one_per_file, mode="FAILFAST")
    blocks = docs.select("doc_id", F.col("title").alias("doc_title"), F.posexplode("blocks").alias("ord", "b"))
    return blocks.select("doc_id", "doc_title", "ord", "b.id", "b.type", F.coalesce("b.text", F.lit("")).alias("text"), "b.level", "b.page_idx", "b.bbox", "b.asset_path", "b.source_path", F.coalesce("b.metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def write_documents(blocks: DataFrame, path: str) -> None:
    """Documents as JSON, one a line, blocks in order."""
    keep = [c for c in ("id", "type", "text", "level", "page_idx", "asset_path", "source_path", "metadata") if c in blocks.columns]
    one = F.struct("ord", F.struct(*keep, F.col("ord").cast("int").alias("order")).alias("b"))  # maps can't be sorted: compare by ord alone
    docs = blocks.groupBy("doc_id", F.col("doc_title").alias("title")).agg(F.array_sort(F.collect_list(one), lambda a, b: F.signum(a["ord"] - b["ord"]).cast("int")).alias("x"))
    docs.select("doc_id", "title", F.transform("x", lambda x: x["b"]).alias("blocks")).write.mode("overwrite").json(path)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Sections of JSONL manifests; ``ord`` counts a document's rows from 0, by file and place in the file."""
    rows = spark.read.schema(SECTION).json(path, mode="FAILFAST").select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    # Rows of one split keep their order, and splits of a file are in order of their starts.
    place = Window.partitionBy("doc_id").orderBy("_file", "_start", "_row")
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).where("id IS NOT NULL")
    return rows.withColumn("ord", F.row_number().over(place).cast("long") - 1).withColumnRenamed("id", "section_id").drop("_file", "_start", "_row")


def write_sections(sections: DataFrame, path: str) -> None:
    """Sections as JSONL, in order within each document; ids are validated first."""
    from quire.operators.validation import require_valid

    rows = require_valid(sections).withColumnRenamed("section_id", "id")
    names = [c.split(" ", 1)[0] for c in SECTION.split(", ") if c.split(" ", 1)[0] in rows.columns]
    rows.repartitionByRange("doc_id", "ord").sortWithinPartitions("doc_id", "ord").select(*names).write.mode("overwrite").json(path)


def count_sections(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank, without parsing them."""
    return spark.read.text(path).where(strip(F.col("value")) != "").count()


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of ``<doc_id>/<section_id>.json`` files; corrupt and misplaced ones are left out."""
    schema = f"{ANNOTATION}, _corrupt string"
    rows = spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", recursiveFileLookup=True, pathGlobFilter="*.json")
    rows = rows.withColumn("_file", F.col("_metadata.file_path"))
    folder, name = F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1), F.regexp_replace(F.regexp_extract("_file", r"([^/]+)$", 1), r"\.json$", "")
    sound = F.col("_corrupt").isNull() & (F.col("doc_id") == F.url_decode(folder)) & (F.col("section_id") == F.url_decode(name)) & is_slug_id(F.col("doc_id"))
    return rows.where(F.coalesce(sound, F.lit(False))).select("doc_id", "section_id", "concepts", F.coalesce("summary", F.lit("")).alias("summary"), "model", "created_at")


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pos, title, page_index, level) of book manifests; rows with a blank title or a level that is no integer go."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True, mode="DROPMALFORMED")
    marks = rows.select(F.col("book_id").alias("doc_id"), F.posexplode("pdf.bookmarks").alias("pos", "m"))
    whole = lambda c: F.col(c).rlike(r"^-?\d+$")
    kept = marks.where((strip(F.coalesce("m.title", F.lit(""))) != "") & F.coalesce(whole("m.level"), F.lit(False)) & (F.col("m.page_index").isNull() | whole("m.page_index")))
    return kept.select("doc_id", "pos", strip(F.col("m.title")).alias("title"), F.col("m.page_index").cast("int").alias("page_index"), F.col("m.level").cast("int").alias("level"))
