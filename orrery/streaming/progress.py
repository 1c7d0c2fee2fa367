"""The engine's own progress of streams as metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..sources import io

#: A metric row of a micro-batch: its rows, the whole time and that of its writing, in ms, and when it began.
BATCH = "rows long, trigger_ms long, add_batch_ms long, began string"


class BatchMetrics(StreamingQueryListener):
    """Writes a row for each micro-batch of the session's streams to a metric table, under the stream's id and the batch's number, so
    that a batch told of again replaces its row. It runs in the driver, on one row a batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        took = p.durationMs
        row = [(p.numInputRows, took.get("triggerExecution", 0), took.get("addBatch", 0), p.timestamp)]
        io.append_metrics(self.spark.createDataFrame(row, BATCH).coalesce(1), self.path, str(p.id), p.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def told(spark: SparkSession) -> None:
    """Waits until all listeners have heard what has happened so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()


def with_progress(spark: SparkSession, path: str, run) -> DataFrame:
    """What run() returns, while the session's streams write their progress to the metric table at path."""
    listener = BatchMetrics(spark, path)
    spark.streams.addListener(listener)
    try:
        out = run()
        told(spark)
        return out
    finally:
        spark.streams.removeListener(listener)
