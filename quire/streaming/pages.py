"""Streams: new page blocks through the batch operators, and sessions over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def process_pages(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, operator: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Run ``operator`` over each batch of new block files and append the result; the checkpoint replaces a page status.

    A batch is written under its own number, so a batch that is run again overwrites its own output only.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, batch or stream: the one-dimensional analogue of splitting paragraphs by gaps."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    rows = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select("user_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n_events", "total")


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("started"), "event_type", "n_events")
