"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from helpers import DATA, assert_same

import __spark_entry__ as entry
from quire.plans.registry import ORACLE_SQL, QUERIES


def test_every_query_but_the_parsers_has_sql():
    assert QUERIES.keys() - ORACLE_SQL.keys() == {"html_blocks", "markdown_blocks"} and ORACLE_SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", ["html_blocks", "markdown_blocks"])
def test_parsers_cut_every_document(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    table, key = {"html_blocks": ("pages", "page_id"), "markdown_blocks": ("documents", "doc_id")}[name]
    assert {r["doc_id"] for r in rows} == {str(r[0]) for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()}
    assert len({(r["doc_id"], r["ord"]) for r in rows}) == len(rows) and all(r["id"] == f"b{r['ord']}" for r in rows)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_matches_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, DATA), duck, ORACLE_SQL[name])


def test_turns_and_books_are_whole(spark, duck):
    from quire.sources import views

    turns = views.v_turn_blocks(spark, DATA).selectExpr("count(*) n", "sum(length(text)) chars").first()
    assert tuple(turns) == duck.execute("SELECT count(*), sum(length(text)) FROM conversations").fetchone()
    books = {r["doc_id"]: r["n"] for r in views.v_sections(spark, DATA).groupBy("doc_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert books == dict(duck.execute("SELECT source, count(*) FROM documents GROUP BY source").fetchall())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_entry_registers_the_engine(spark):
    assert QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
