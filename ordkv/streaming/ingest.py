"""Streams of operations into a store, a run for each micro-batch (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..store import Store


def ingest(ops: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Write a stream of (ord, kind, key, value); order between batches is that of arrival.

    A micro-batch that is run again after a failure writes the same operations under new numbers, which
    gives the same state.
    """
    return ops.writeStream.foreachBatch(lambda batch, _: store.write_batch(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
