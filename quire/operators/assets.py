"""Images, tables and charts of sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_url, remove_once, strip

ASSET_TYPES = ("image", "table", "chart")
RESIDUAL_CHARS = 15


def relative_path(path: Column) -> Column:
    """The path inside the document's folder without '.' and '..' steps; null if it is empty, absolute, a URL or leaves it."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("inside"))
    walked = F.aggregate(
        steps,
        start,
        lambda a, s: F.when(s == "..", F.struct(F.slice(a["kept"], F.lit(1), F.greatest(F.size(a["kept"]) - 1, F.lit(0))).alias("kept"), (a["inside"] & (F.size(a["kept"]) > 0)).alias("inside"))).otherwise(
            F.struct(F.concat(a["kept"], F.array(s)).alias("kept"), a["inside"].alias("inside"))
        ),
    )
    bad = path.isNull() | (path == "") | is_url(path) | F.startswith(path, F.lit("/")) | F.contains(path, F.lit("\0"))
    return F.when(~bad & walked["inside"] & (F.size(walked["kept"]) > 0), F.array_join(walked["kept"], "/"))


def section_assets(sections: DataFrame, blocks: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, section_id, pos, block_id, type, caption, path): assets of each section's blocks that are files of it.

    ``files`` (doc_id, path) lists what exists under a document's folder; ``images/`` is tried first.  ``pos`` is the
    block's place in the section.
    """
    refs = sections.select("doc_id", "section_id", F.posexplode("block_ids").alias("pos", "block_id"))
    assets = blocks.where(F.col("type").isin(*ASSET_TYPES)).select("doc_id", F.col("id").alias("block_id"), "type", F.col("text").alias("caption"), relative_path(F.col("asset_path")).alias("_path")).where("_path IS NOT NULL")
    listed = files.select("doc_id", F.col("path").alias("_file")).distinct()
    tried = refs.join(assets, ["doc_id", "block_id"]).withColumn("_try", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.concat(F.lit("images/"), "_path").alias("_file")), F.struct(F.lit(1).alias("n"), F.col("_path").alias("_file")))))
    met = tried.select("doc_id", "section_id", "pos", "block_id", "type", "caption", "_try.n", "_try._file").join(listed, ["doc_id", "_file"])
    return met.groupBy("doc_id", "section_id", "pos", "block_id", "type", "caption").agg(F.min(F.struct("n", "_file")).alias("best")).select("doc_id", "section_id", "pos", "block_id", "type", F.coalesce("caption", F.lit("")).alias("caption"), F.col("best._file").alias("path"))


def asset_notes(sections: DataFrame, assets: DataFrame) -> DataFrame:
    """(doc_id, section_id, assets, note): a note where a section's text is little more than its captions."""
    per = assets.groupBy("doc_id", "section_id").agg(F.count(F.lit(1)).alias("assets"), F.array_sort(F.collect_list(F.struct("pos", "caption"))).alias("_captions"))
    residual = F.aggregate("_captions", strip(F.col("text")), lambda t, c: remove_once(t, strip(c["caption"])))
    note = F.when(F.length(strip(residual)) <= RESIDUAL_CHARS, F.concat(F.lit("This section is little more than "), F.col("assets").cast("string"), F.lit(" asset(s); read the file(s), not just the text.")))
    return sections.select("doc_id", "section_id", "text").join(per, ["doc_id", "section_id"]).select("doc_id", "section_id", "assets", note.alias("note"))
