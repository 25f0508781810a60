"""Queries over annotations whose sections' titles have no letters or digits, are empty or null, against their SQL."""

from __future__ import annotations

import os

import duckdb
import pytest
from helpers import DATA, assert_same
from pyspark.errors import PySparkException

from quire.operators import concepts
from quire.plans.registry import ORACLE_SQL, QUERIES

TEXTS = ("", None, "   ", "!!! ...", "— é —\nBody of a Text", "\nsecond Line", "  Two   Words \nx", "Untitled\nabc", "日本語")
SCHEMA = "doc_id string, section_id string, concepts array<struct<slug:string,title:string,gloss:string>>, summary string"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The smallest tables, with a good, a poor and a toxic document of each text more."""
    folder = tmp_path_factory.mktemp("odd")
    for name in os.listdir(DATA):
        os.symlink(f"{DATA}/{name}", folder / name)
    docs, labels = (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("documents", "labels"))
    kinds = [(1, 0), (0, 0), (0, 1)]
    rows = [(10**7 + i, t, "en", f"src{i % 4}", len(t or ""), *kind) for i, (t, kind) in enumerate((t, kind) for t in TEXTS for kind in kinds)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int, toxic int")
    for name, old in (("documents", docs), ("labels", labels)):
        os.unlink(folder / f"{name}.parquet")
        old.unionByName(more.select(*old.columns)).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["annotated_mention_count", "annotation_dedup", "concept_mentions_merged", "concept_mentions_of", "concept_nodes", "concepts_bulk", "index_concepts", "section_concepts", "render_concept_page"])
def test_untitled_concepts_match_sql(spark, odd, name):
    connection = duckdb.connect()
    for table in ("documents", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{odd}/{table}.parquet/*.parquet'")
    assert_same(QUERIES[name](spark, odd), connection, ORACLE_SQL[name])


def test_stored_untitled_concepts_fail_no_build_but_are_refused_when_given(spark):
    given = spark.createDataFrame([("d", "s", [("", " é ", "g"), ("", "-", "late"), ("a", "", "")], "")], SCHEMA)
    assert [tuple(c) for c in concepts.resolve_annotations(given, strict=False).first()["concepts"]] == [("untitled", "é", "g"), ("a", "a", "")]
    with pytest.raises(PySparkException, match="title or slug"):
        concepts.resolve_annotations(given).collect()
