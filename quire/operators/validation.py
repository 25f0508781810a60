"""Identifier checks over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_section_id


class InvalidIdError(ValueError):
    """An identifier that isn't safe as a file name, or isn't unique."""


def unsafe_ids(sections: DataFrame) -> DataFrame:
    """Sections whose id isn't made of slugs joined by dots."""
    return sections.where(~is_section_id(F.col("section_id"))).select("doc_id", "section_id")


def duplicate_ids(sections: DataFrame) -> DataFrame:
    """(doc_id, section_id, n) of ids that more than one section of a document has."""
    return sections.groupBy("doc_id", "section_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_valid(sections: DataFrame) -> DataFrame:
    """``sections``, or an error that names one bad id."""
    for bad, what in ((unsafe_ids(sections), "unsafe"), (duplicate_ids(sections), "duplicate")):
        row = bad.first()
        if row:
            raise InvalidIdError(f"{what} section id {row['section_id']!r} in {row['doc_id']!r}")
    return sections
