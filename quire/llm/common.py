"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session on one machine (``local``) that has none gets one; on a cluster it has to be set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def unused(columns: list[str], name: str) -> str:
    """``name``, or with underscores before it what no column is called."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of a scan's size, so nothing is read for it; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def partition_count(df: DataFrame, bytes_each: int) -> int:
    """How many partitions keep shares of ``df`` under ``bytes_each`` of its files' size, the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-estimated_bytes(df) // bytes_each))


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` hash partitions, some thousands at most, an int that ``repartition(n, key)`` sends there."""
    key = F.col("id").cast("int")
    found = dict(spark.range(24 * n + 64).groupBy(F.pmod(F.hash(key), F.lit(n)).alias("p")).agg(F.min(key).alias("key")).collect())  # n rows at most
    return [found.get(p, p) for p in range(n)]


#: Rows of a key that a task joins at least before the key counts as hot, and the part of all rows that it joins at most.
LEAST_HOT, HOT_SHARE = 200, 100_000


def join_skewed(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has a row per ``key`` at most; keys aren't null.

    A key of more than ``LEAST_HOT`` rows and a ``HOT_SHARE``-th of all rows is dealt out over as many tasks as keep each
    under that, its row of ``right`` to each of them.  There are ``HOT_SHARE`` such keys at most, so their numbers of tasks
    are broadcast.  ``counts`` (key, n) spares counting the keys of ``left``.
    """
    counts = counts if counts is not None else left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    most = max(LEAST_HOT, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    salts, salt = unused([*left.columns, *right.columns], "_salts"), unused([*left.columns, *right.columns], "_salt")
    hot = F.broadcast(counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias(salts)))
    dealt = left.join(hot, key, "left").withColumn(salt, F.pmod(F.xxhash64(*left.columns), F.coalesce(salts, F.lit(1))).cast("int"))
    copied = right.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1))).drop(salts)
    return dealt.drop(salts).join(copied, [key, salt], how).drop(salt)


#: A table of this size at most, as its files have it, is sent to all tasks.
BROADCAST_BYTES = 32 << 20


def join_small(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``left`` joined with the written table ``right``, by broadcast while its files are small, else as ``join_skewed``."""
    return left.join(F.broadcast(right), key, how) if estimated_bytes(right) <= BROADCAST_BYTES else join_skewed(left, right, key, how)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that no model may learn from: crc32 of the id's text leaves 1 when divided by 3 (null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
