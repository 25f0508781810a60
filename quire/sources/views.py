"""The engine's frames made from the test tables: sections, blocks, bookmarks, annotations and reading plans.

A book of ``v_sections`` is a source with all its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONCEPT = "struct<slug:string,title:string,gloss:string>"


#: A scan task's share of an input that has fewer files than the cluster has cores.
SMALL_BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; one of few small files, which few tasks would scan, is spread over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores, files = spark.sparkContext.defaultParallelism, len(df.inputFiles())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if files < cores and 1 << 20 < size < cores * SMALL_BYTES else df


def v_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, section_id, ord, title, level, heading_path, text: a section per document."""
    docs = table(spark, sf_dir, "documents")
    title = F.substring_index("text", "\n", 1)
    return docs.select(
        F.col("source").alias("doc_id"), F.concat("source", F.lit(".d"), F.col("doc_id").cast("string")).alias("section_id"), F.col("doc_id").alias("ord"), title.alias("title"),
        (1 + F.col("doc_id") % 3).cast("int").alias("level"), F.array(title).alias("heading_path"), "text",
    )


def v_line_blocks(spark: SparkSession, sf_dir: str, paged: bool = True) -> DataFrame:
    """A text block per line of each document, four lines a page or no pages."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    page = F.floor(F.col("ord") / 4).cast("int") if paged else F.lit(None).cast("int")
    return lines.select("doc_id", "ord", F.concat(F.lit("b"), "ord").alias("id"), F.lit("text").alias("type"), "text", F.lit(None).cast("int").alias("level"), page.alias("page_idx"), F.concat(F.lit("Document "), "doc_id").alias("doc_title"))


def v_turn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block per conversation turn, with its whole text: system and user turns are titles of level 1 and 2, two turns a page."""
    turns = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "assistant", "text").otherwise("title")
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2)
    return turns.select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("ord"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), kind.alias("type"), "text",
        level.cast("int").alias("level"), F.floor(F.col("turn") / 2).cast("int").alias("page_idx"), F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("doc_title"),
    )


def v_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bookmark per user turn, labelled by its first line."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select(
        F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("pos"), F.substring_index("text", "\n", 1).alias("title"), F.floor(F.col("turn") / 2).cast("int").alias("page_index"), (1 + F.col("turn") % 2).cast("int").alias("level")
    )


def v_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of labelled documents: toxic ones prune all concepts, poor ones replace them, others only have a summary."""
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    title = F.substring_index("text", "\n", 1)
    concepts = F.when(F.col("toxic") == 1, F.array().cast(f"array<{CONCEPT}>")).when(F.col("quality") == 0, F.array(F.struct(F.lit("").alias("slug"), title.alias("title"), F.lit("from label").alias("gloss"))))
    summary = F.when((F.col("toxic") == 0) & (F.col("quality") == 1), title).otherwise("")
    return labels.select(F.col("source").alias("doc_id"), F.concat("source", F.lit(".d"), F.col("doc_id").cast("string")).alias("section_id"), concepts.alias("concepts"), summary.alias("summary"))


def v_plan(spark: SparkSession, sf_dir: str, daily_sections: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plans, plan_sections, plan_completed): a plan per book; labelled documents have been read."""
    sections = v_sections(spark, sf_dir).select(F.col("doc_id").alias("plan_id"), F.col("ord").alias("pos"), "section_id")
    plans = sections.select("plan_id", F.col("plan_id").alias("doc_id"), F.lit(daily_sections).alias("daily_sections")).distinct()
    read = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos")).distinct()
    return plans, sections, sections.join(read, "pos").select("plan_id", F.col("pos").alias("seq"), "section_id")
