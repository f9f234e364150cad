"""Incremental ingest: a stream of chunks of which only unseen ones are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from chunkwright.sources.store import Store


def ingest_stream(chunks: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Stores the chunks (hash, size, content) of all batches that are there now, then stops.

    The store's own tables are the state: a batch that is run again finds its chunks stored.
    """
    return chunks.writeStream.foreachBatch(lambda batch, _: store.put(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
