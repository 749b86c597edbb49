"""Streams into catalogue tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Catalog


def into_table(stream: DataFrame, catalog: Catalog, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends each micro-batch to a catalogue table once, though the stream may deliver a batch again after a failure.  The checkpoint names the stream."""
    name = hashlib.md5(checkpoint.encode()).hexdigest()
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: catalog.write_batch(table, batch, name, n))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
