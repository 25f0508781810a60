from __future__ import annotations

import hashlib

import pytest
from helpers import DATA, assert_same
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quire.llm import warc

BIG = "<p>" + "x" * 2000


@pytest.fixture
def pages(spark):
    rows = [(1, "http://a/1", BIG), (5, "http://a/5", BIG), (3, "http://a/3", BIG), (2, "http://b/", "small"), (4, "http://b/", "small"), (6, None, None), (7, "http://c/ x\r\ny", ""), (8, "http://d/é", "é" * 600), (9, "http://d/9", "é" * 600), (None, "http://n/", BIG)]
    return spark.createDataFrame([(*r, "zz", 1, "q") for r in rows], "page_id long, url string, html string, digest string, newest long, header string").repartition(3)


def test_query_matches_sql(spark, duck):
    assert_same(warc.op10_warc(spark, DATA), duck, warc.OP10_SQL)


def test_records_and_revisits(spark, pages, tmp_path):
    archive = warc.write_archive(pages, f"file://{tmp_path}/w")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_records(spark, archive).collect()}
    assert got == {1: (2003, "revisit", 5), 3: (2003, "revisit", 5), 5: (2003, "response", None), None: (2003, "revisit", 5), 2: (5, "response", None), 4: (5, "response", None), 6: (0, "response", None), 7: (0, "response", None), 8: (1200, "revisit", 9), 9: (1200, "response", None)}
    assert spark.read.parquet(archive.payloads).count() == 4


def parse(record):
    head, _, content = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.1" and content.endswith(b"\r\n\r\n")
    return dict(x.split(": ", 1) for x in lines[1:]), content[:-4]


def test_records_are_rebuilt_byte_for_byte(spark, pages, tmp_path):
    archive = warc.write_archive(pages, f"file://{tmp_path}/w")
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    ids = set()
    for r in warc.reconstruct(spark, archive).collect():
        fields, content = parse(bytes(r["record"]))
        assert bytes(r["payload"]) == html[r["page_id"]]
        assert content == (b"" if fields["WARC-Type"] == "revisit" else html[r["page_id"]]) and int(fields["Content-Length"]) == len(content)
        assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(html[r["page_id"]]).hexdigest()
        ids.add(fields["WARC-Record-ID"])
    assert len(ids) == len(html)


def test_damaged_payloads_fail_the_read(spark, pages, tmp_path):
    archive = warc.write_archive(pages, f"file://{tmp_path}/w")
    hurt = spark.read.parquet(archive.payloads).withColumn("payload", F.when(F.length("payload") == 5, F.lit(b"other")).otherwise(F.col("payload")))
    hurt.write.parquet(f"file://{tmp_path}/hurt/payloads")
    spark.read.parquet(archive.records).write.parquet(f"file://{tmp_path}/hurt/records")
    with pytest.raises(PySparkException, match="does not match"):
        warc.read_records(spark, warc.Archive(f"file://{tmp_path}/hurt")).collect()


def test_empty_and_ties(spark, pages, tmp_path):
    assert warc.read_records(spark, warc.write_archive(pages.where("false"), f"file://{tmp_path}/e")).count() == 0
    twice = spark.createDataFrame([(1, "u", BIG), (1, "u", BIG)], "page_id long, url string, html string")
    assert {r["record_type"] for r in warc.read_records(spark, warc.write_archive(twice, f"file://{tmp_path}/t")).collect()} == {"response"}
    unnamed = spark.createDataFrame([(None, "u", BIG), (None, "v", BIG)], "page_id long, url string, html string")
    assert {r["record_type"] for r in warc.read_records(spark, warc.write_archive(unnamed, f"file://{tmp_path}/n")).collect()} == {"response"}
