"""Streaming ingest: blocks that arrive are cut into sections and indexed, a micro-batch of documents at a time.

Beyond the batch operators this adds no semantics: each batch goes through the same segmentation and the same rebuild
of the documents in it.  A batch that is run again after a failure only makes a newer build of the same documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators import segment
from quire.operators.index import SectionIndex


def index_stream(blocks: DataFrame, index: SectionIndex, checkpoint: str, cut: Callable[[DataFrame], DataFrame] = segment.by_heading, once: bool = False) -> StreamingQuery:
    """Starts indexing ``blocks`` (a stream whose batches hold whole documents); ``once`` stops after what is there."""

    def build(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            index.build(cut(batch), titles=batch.select("doc_id", batch["doc_title"].alias("title")).distinct())

    writer = blocks.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def block_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blocks from Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)
