"""Memory samples as a stream: running peaks by device."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_dir


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(path)


def running_peaks(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Peak of each key so far. The state is one number a key."""
    return samples.groupBy(key).agg(F.max(value).alias("peak"))


def windowed_peaks(samples: DataFrame, key: str, value: str, ts: str = "ts", width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Peak of each key and time window; windows older than the watermark are dropped from the state."""
    return samples.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.max(value).alias("peak"))


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there, and returns the result table, in the shared folder.

    complete: each batch holds the whole result, of which the last one counts. append, update: all batches, so an
    updated key has a row for each batch that changed it. A batch that is run again replaces its own rows.
    """
    at = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/table/batch={number}")
        last.append(number)

    each_batch(stream, keep, f"{at}/progress", mode).awaitTermination()
    if not last:
        return stream.sparkSession.createDataFrame([], stream.schema)
    paths = [f"{at}/table/batch={last[-1]}"] if mode == "complete" else [f"{at}/table/batch={k}" for k in sorted(set(last))]
    return stream.sparkSession.read.schema(stream.schema).parquet(*paths)


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Calls act with each micro-batch: the hook for periodic evaluation and metric sinks."""
    return stream.writeStream.outputMode(mode).foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
