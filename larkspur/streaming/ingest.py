"""Structured Streaming ingest into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from larkspur.store import DocumentStore


def ingest(changes: DataFrame, store: DocumentStore, checkpoint: str, name: str = "ingest", rejects: str | None = None, **trigger) -> StreamingQuery:
    """Append a stream of (url, content[, metadata, type, op, seq]) to the store, one commit a micro-batch.

    Exactly once: the manifest holds the last batch of each stream, so a batch that is replayed after a
    crash is skipped if it was committed and written anew if it was not.  Rejected rows go
    to Parquet in `rejects`, by batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.refresh()
        if batch_id <= store._state["streams"].get(name, -1):
            return
        held = batch.persist()
        try:
            _, bad = store.put_many(held, (name, batch_id))
            if rejects:
                bad.write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")
        finally:
            held.unpersist()

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name).trigger(**(trigger or {"availableNow": True})).start()
