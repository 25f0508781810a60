"""Queries over extracted concepts where documents of one id have different texts, against their SQL."""

from __future__ import annotations

import os

import duckdb
import pytest
from helpers import DATA, assert_same

from quire.operators import concepts
from quire.plans.registry import ORACLE_SQL, QUERIES

# Equal first lines, as the SQL leaves the order of one id's lines open.
TEXTS = {
    10**7: ("same title\nthe Thtion of Many Words, spelling longer tokens", "same title\nno", "same title\nno"),
    10**7 + 1: ("a poor one\nmore Thtion", "a poor one"),
    10**7 + 2: ("plain one\nspelling again",),
}
LABELS = [(10**7 + 1, 0, 0), (10**7 + 2, 1, 0)]


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    """The smallest tables, with a source more whose documents share ids."""
    folder = tmp_path_factory.mktemp("clashing")
    for name in os.listdir(DATA):
        os.symlink(f"{DATA}/{name}", folder / name)
    documents = [(i, text, "en", "clash", len(text)) for i, texts in TEXTS.items() for text in texts]
    for name, rows, kind in (("documents", documents, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", LABELS, "doc_id long, quality int, toxic int")):
        old = spark.read.parquet(f"{DATA}/{name}.parquet")
        os.unlink(folder / f"{name}.parquet")
        old.unionByName(spark.createDataFrame(rows, kind).select(*old.columns)).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["concept_mentions_merged", "concept_mentions_of", "concept_nodes", "concepts_bulk", "section_concepts", "render_concept_page", "annotated_mention_count", "index_concepts", "concepts_top50"])
def test_clashing_ids_match_sql(spark, clashing, name):
    connection = duckdb.connect()
    for table in ("documents", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{clashing}/{table}.parquet/*.parquet'")
    assert_same(QUERIES[name](spark, clashing), connection, ORACLE_SQL[name])


def test_a_key_is_spelled_as_in_a_text_that_has_it(spark):
    rows = [("d", "s", 0, "one", ["one"], text) for text in ("Alpha of Beta", "", "of", "ALPHA of gammas")]
    found = concepts.extract_concepts(spark.createDataFrame(rows, "doc_id string, section_id string, ord long, title string, heading_path array<string>, text string")).collect()
    assert {(r["slug"], r["title"], tuple(r["section_ids"])) for r in found} == {("one", "one", ("s",)), ("alpha-beta", "Alpha Beta", ("s",)), ("alpha", "ALPHA", ("s",)), ("gammas", "gammas", ("s",))}
