"""Content-addressed WARC archive.

An archive is two tables.  ``payloads`` stores each distinct payload once, under its SHA-256; ``records`` holds the
exact header block of every record and the digest of its payload, but no payload.  Reading joins the two on the digest
and gives back every record byte for byte, as WARC/1.1 text.  Payload digests are verified on reading: length, SHA-1
and SHA-256 are taken anew from the stored bytes, and a record whose header says otherwise makes the read fail.

Of the records of one payload of at least ``least_bytes`` bytes the one with the largest page_id is a response and the
others are revisits that name it; smaller ones are all responses.

What moves: digests and ids are written as a narrow table first and grouped without payloads, summed per task; a
digest that a thousandth of all records share meets its row by broadcast, so one payload in a third of the records is
no hot group.  Payloads move once, one row per distinct digest and task, to be stored.

Defined results: null html is the empty payload; a null page_id is never chosen as response over another one, and
where a payload has no other, its records are all responses; records that share the largest page_id are all
responses; a null url leaves the target header out; white space in a url that would break the header is
percent-encoded; an empty table gives an empty archive; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import fresh_path, join_skewed, materialize, table

LEAST_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
_EOL = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Where the two tables lie."""

    path: str

    @property
    def payloads(self) -> str:
        return f"{self.path}/payloads"

    @property
    def records(self) -> str:
        return f"{self.path}/records"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))


def _urn(*parts: Column) -> Column:
    """A record id that is the same each time the record is written."""
    x = F.md5(F.concat_ws(" ", *parts))
    return F.concat(F.lit("<urn:uuid:"), *(piece for i, (at, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for piece in ([F.lit("-")] if i else []) + [F.substring(x, at, n)]), F.lit(">"))


def _safe_url(url: Column) -> Column:
    for char, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(char), F.lit(code))
    return url


def header_block(date: str = DATE) -> Column:
    """The exact WARC header of a row with page_id, url, record_type, refers_to, newest_url, payload_sha1 and content_length."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _urn(page, F.col("payload_sha1"), F.coalesce("url", F.lit("")))),
        F.coalesce(_line("WARC-Target-URI", _safe_url(F.col("url"))), F.lit("")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_sha1"))),
        _line("WARC-Page-ID", page),
        F.when(F.col("refers_to").isNotNull(), _line("WARC-Refers-To", _urn(F.col("refers_to").cast("string"), F.col("payload_sha1"), F.coalesce("newest_url", F.lit(""))))).otherwise(F.lit("")),
        F.coalesce(_line("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string")), F.lit("")),
        F.when(F.col("record_type") == "revisit", _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.col("content_length").cast("string")),
        F.lit(_EOL),
    )


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> Archive:
    """Writes a record per row of ``pages`` (page_id, url, html)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    digested = materialize(rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("payload_sha1"), F.length("payload").cast("long").alias("payload_bytes")), "digests")
    newest = digested.groupBy("digest").agg(F.max("page_id").alias("newest"), F.max_by("url", F.struct("page_id", "url")).alias("newest_url"))
    revisit = (F.col("payload_bytes") >= least_bytes) & F.coalesce(~F.col("page_id").eqNullSafe(F.col("newest")) & F.col("newest").isNotNull(), F.lit(False))
    records = (
        join_skewed(digested, newest, "digest")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("newest")))
        .withColumn("content_length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")))
    )
    archive = Archive(path)
    records.select("page_id", "digest", header_block(date).alias("header")).write.parquet(archive.records)
    once = rows.select(F.sha2("payload", 256).alias("digest"), "payload").dropDuplicates(["digest"])
    once.write.option("compression", "zstd").parquet(archive.payloads)
    return archive


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """What each record's header says, beside what its stored payload is: no payload moves."""
    records = spark.read.schema("page_id long, digest string, header string").parquet(archive.records)
    stored = spark.read.schema("digest string, payload binary").parquet(archive.payloads)
    taken = materialize(stored.select("digest", F.sha2("payload", 256).alias("again"), F.sha1("payload").alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes")), "taken")
    page, refers_to = _field("WARC-Page-ID"), _field("WARC-Refers-To-Page-ID")
    read = join_skewed(records, taken, "digest", "left").select(
        F.when(page != "", page.cast("long")).alias("page_id"), "payload_bytes", "payload_digest", _field("WARC-Type").alias("record_type"), F.when(refers_to != "", refers_to.cast("long")).alias("refers_to"),
        "digest", "again", _field("WARC-Payload-Digest").alias("said"), _field("Content-Length").cast("long").alias("content_length"),
    )
    sound = F.coalesce((F.col("again") == F.col("digest")) & (F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & ((F.col("record_type") == "revisit") | (F.col("content_length") == F.col("payload_bytes"))), F.lit(False))
    broken = F.raise_error(F.concat(F.lit("archive record does not match its payload "), F.col("digest")))
    return read.select("page_id", F.when(sound, F.col("payload_bytes")).otherwise(broken.cast("long")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def reconstruct(spark: SparkSession, archive: Archive) -> DataFrame:
    """(page_id, record): the original records byte for byte, header, content and closing line ends; and payload."""
    records = spark.read.schema("page_id long, digest string, header string").parquet(archive.records)
    stored = spark.read.schema("digest string, payload binary").parquet(archive.payloads)
    content = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return join_skewed(records, stored, "digest").select("page_id", F.concat(F.col("header").cast("binary"), content, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(spark, write_archive(table(spark, sf_dir, "pages"), fresh_path(spark, "warc")))


OP10_SQL = f"""
WITH digested AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), newest AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS newest FROM digested
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> newest THEN newest END AS refers_to
FROM newest
"""
