"""Structured Streaming front of the index: each micro-batch of documents is appended to a postings table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.index import lengths, postings


def index_stream(documents: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Consumes (ordinal, text) until the source is drained; a replayed batch overwrites its own part."""

    def each(batch: DataFrame, epoch: int) -> None:
        postings(batch).write.mode("overwrite").parquet(f"{root}/postings/batch={epoch}")
        lengths(batch).write.mode("overwrite").parquet(f"{root}/lengths/batch={epoch}")

    return documents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
