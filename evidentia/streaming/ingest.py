"""Extensions on Structured Streaming: incremental chunk ingest and currency windows over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def currency_windows(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts and sums of events a window and kind. State is dropped once the watermark passes a window."""
    e = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def ingest(stream: DataFrame, chunker, path: str, checkpoint: str):
    """Chunks what arrives and appends it; each file once, also after a failure."""
    return chunker(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
