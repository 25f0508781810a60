"""Reading plans: (plan_id, doc_id, daily_sections), (plan_id, pos, section_id) and (plan_id, seq, section_id) of what is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class UnknownSectionError(ValueError):
    """A section that the plan doesn't have."""


class PlanCompleteError(ValueError):
    """Nothing is left to read."""


def create_plan(sections: DataFrame, plan_id: str, doc_id: str, daily_sections: int = 1) -> tuple[DataFrame, DataFrame]:
    """(plans, plan_sections) of one new plan over a document's sections in reading order."""
    if daily_sections < 1:
        raise ValueError("daily_sections must be at least 1")
    own = sections.where(F.col("doc_id") == doc_id).select(F.lit(plan_id).alias("plan_id"), F.col("ord").alias("pos"), "section_id")
    plan = sections.sparkSession.range(1).select(F.lit(plan_id).alias("plan_id"), F.lit(doc_id).alias("doc_id"), F.lit(daily_sections).alias("daily_sections"))
    return plan, own


def unread(plan_sections: DataFrame, completed: DataFrame) -> DataFrame:
    return plan_sections.join(completed.select("plan_id", "section_id"), ["plan_id", "section_id"], "left_anti").select("plan_id", "pos", "section_id")


def next_batch(plans: DataFrame, plan_sections: DataFrame, completed: DataFrame) -> DataFrame:
    """The first ``daily_sections`` unread sections of each plan (plan_id, doc_id, pos, section_id); nothing is marked."""
    order = Window.partitionBy("plan_id").orderBy("pos")
    left = unread(plan_sections, completed).withColumn("_nr", F.row_number().over(order))
    return left.join(plans, "plan_id").where(F.col("_nr") <= F.col("daily_sections")).select("plan_id", "doc_id", "pos", "section_id")


def mark_read(plan_sections: DataFrame, completed: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """``completed`` after marking: (plan_id, section_id) in ``marks``, a null section meaning the next unread one.

    Marking twice changes nothing; marking a section that the plan lacks, or the next one of a plan that has none,
    fails.  Without ``marks`` the next unread section of every plan is marked, where there is one.
    """
    first = unread(plan_sections, completed).groupBy("plan_id").agg(F.min(F.struct("pos", "section_id")).alias("first")).select("plan_id", F.col("first.section_id").alias("_next"))
    seq = completed.groupBy("plan_id").agg(F.max("seq").alias("_last"))
    if marks is None:
        wanted = first.select("plan_id", F.col("_next").alias("section_id"))
    else:
        own = plan_sections.select("plan_id", F.col("section_id").alias("_known"), F.lit(True).alias("_has"))
        named = marks.join(first, "plan_id", "left").withColumn("_asked", F.coalesce("section_id", "_next")).drop("section_id")
        met = named.join(own.withColumnRenamed("plan_id", "_plan"), (F.col("plan_id") == F.col("_plan")) & (F.col("_asked") == F.col("_known")), "left")
        fail = F.raise_error(F.when(F.col("_asked").isNull(), F.lit("the plan is complete")).otherwise(F.concat(F.lit("the plan has no section "), F.col("_asked")))).cast("string")
        wanted = met.select("plan_id", F.when(F.col("_has"), F.col("_asked")).otherwise(fail).alias("section_id")).distinct()
    fresh = wanted.join(completed.select("plan_id", "section_id"), ["plan_id", "section_id"], "left_anti").join(seq, "plan_id", "left")
    return completed.select("plan_id", "seq", "section_id").unionByName(fresh.select("plan_id", (F.coalesce("_last", F.lit(-1)) + 1).alias("seq"), "section_id"))


def progress(plans: DataFrame, plan_sections: DataFrame, completed: DataFrame) -> DataFrame:
    """(plan_id, doc_id, completed, total, done): done when there are sections and as many or more are read."""
    total = plan_sections.groupBy("plan_id").agg(F.count(F.lit(1)).alias("total"))
    read = completed.groupBy("plan_id").agg(F.count(F.lit(1)).alias("completed"))
    met = plans.join(total, "plan_id", "left").join(read, "plan_id", "left").select("plan_id", "doc_id", F.coalesce("completed", F.lit(0)).alias("completed"), F.coalesce("total", F.lit(0)).alias("total"))
    return met.withColumn("done", (F.col("total") > 0) & (F.col("completed") >= F.col("total")))
