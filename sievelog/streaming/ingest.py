"""Structured Streaming into a store, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store


def stream_into(store: Store, lines: DataFrame, checkpoint: str, source: str | None = None, line: str = "line", interval: str | None = "300 milliseconds", once: bool = False) -> StreamingQuery:
    """Start a query that ingests every micro-batch. A batch that Spark repeats after a failure finds its id in the
    manifest and is left out; the manifest is what commits it. Batches are counted by `source`, which is the checkpoint
    unless given, so that several streams can fill one store. `once`: take what is there and end.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        store.ingest(batch, line, source=source or checkpoint, batch_id=batch_id)

    writer = lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
