"""Structured Streaming into a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from emberlog.store import KVStore


def ingest(changes: DataFrame, store: KVStore, name: str, checkpoint: str, order_by: Column | None = None, available_now: bool = True) -> StreamingQuery:
    """Commit each micro-batch of a stream (key, value, deleted) as one run.

    The batch number is part of the manifest's commit, so a batch that Spark repeats after a crash is left out: exactly once.
    """

    def commit(batch: DataFrame, number: int) -> None:
        store.put_all(batch, order_by, stream=name, batch=number)

    writer = changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
