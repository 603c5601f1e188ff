"""Streaming arrivals into a store: an extension, as plan images and feedback keep coming.

Each micro-batch is reduced to the last row of its keys and put into the store. A batch that is replayed after a failure puts the same
rows again, so the result is the same. Rows later than the watermark are dropped by `windowed_counts` only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fernglass.operators import state
from fernglass.sources.store import Store


def upsert_into(stream: DataFrame, store: Store, order: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start putting a stream's rows into a store, latest by `order`; with `once` it ends when all that is there was read."""

    def put(batch: DataFrame, _: int) -> None:
        rows = batch.persist()
        store.put(state.latest(rows, store.key, order, order))
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(feedback: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of ratings in windows of event time, with a watermark."""
    rows = feedback.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "rating").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "rating", "n")
