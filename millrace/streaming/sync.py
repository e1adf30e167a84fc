"""Synchronisation of a stream of source rows: each micro-batch is applied to the versioned sink.

The truth stays in the sink, so a batch that is delivered again finds its tokens stored and changes
nothing: delivery at least once gives each source's last state exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sync import VersionedTable, sync


def apply_batch(table: VersionedTable, produce: Callable[[DataFrame], DataFrame], schema: str, order: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: of a source that comes more than once in a batch, the last by ``order`` counts (a
    sequence number or time of change; of equal ones that of the greatest token); sources that a batch doesn't name are left alone."""

    def run(batch: DataFrame, _: int) -> None:
        last = Window.partitionBy("source_id").orderBy(F.col(order).desc(), F.col("token").desc())
        rows = batch.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
        sync(table, rows, produce, schema, delete_orphans=False)

    return run


def start(stream: DataFrame, table: VersionedTable, produce: Callable[[DataFrame], DataFrame], schema: str, checkpoint: str, order: str):
    """Everything that is there now, in micro-batches, then stop."""
    return stream.writeStream.foreachBatch(apply_batch(table, produce, schema, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling windows; on a stream, rows later than ``late`` are dropped."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    sums = marked.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return sums.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
