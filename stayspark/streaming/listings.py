"""Captured cards as a stream: each micro-batch is extracted (X1) and
appended to the listings log as its own batch partition, or merged into a
:class:`ListingStore` (K1).

``foreachBatch`` gets a batch id that is stable across retries, and the store
overwrites exactly the partition of that batch and of this query's id, so a
replayed batch is written once. The query's id lives in the checkpoint: a new
or lost checkpoint starts batch numbers anew, but under a new id. The
checkpoint folder must be on shared storage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from stayspark.operators.market import extract_cards
from stayspark.sources.market_store import ListingStore, append_batch

#: Local property in which Spark keeps the id of the query that runs a batch.
QUERY_ID = "sql.streaming.queryId"


def start_listing_upsert(cards_stream: DataFrame, store_root: str, checkpoint: str,
                         available_now: bool = True) -> StreamingQuery:
    def handle(batch: DataFrame, batch_id: int) -> None:
        run_id = batch.sparkSession.sparkContext.getLocalProperty(QUERY_ID)
        if not run_id:
            raise RuntimeError("no streaming query id")
        append_batch(extract_cards(batch), store_root, run_id, batch_id)

    return _start(cards_stream, handle, checkpoint, available_now)


def start_listing_merge(cards_stream: DataFrame, store_root: str, checkpoint: str, order: Sequence[str], buckets: int = 64,
                        available_now: bool = True) -> StreamingQuery:
    """Merge each micro-batch into the store; a replayed batch changes nothing."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run_id = spark.sparkContext.getLocalProperty(QUERY_ID)
        if not run_id:
            raise RuntimeError("no streaming query id")
        ListingStore(spark, store_root, order, buckets).merge(extract_cards(batch), run_id, batch_id)

    return _start(cards_stream, handle, checkpoint, available_now)


def _start(stream: DataFrame, handle, checkpoint: str, available_now: bool) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
