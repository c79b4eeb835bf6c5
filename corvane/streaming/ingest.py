"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.functions.text import token_count


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_within(rows: DataFrame, key: str, event_time: str, lateness: str) -> DataFrame:
    """Rows of a stream whose key did not occur within the watermark: deliveries are at
    least once, results are not repeated."""
    return rows.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(rows: DataFrame, event_time: str, group: str, window: str, lateness: str) -> DataFrame:
    """(window_start, group, rows, tokens) of event-time windows, late rows within the
    watermark included."""
    return (
        rows.withWatermark(event_time, lateness)
        .groupBy(F.window(event_time, window).alias("w"), group)
        .agg(F.count("*").alias("rows"), F.sum(token_count(F.col("text"))).alias("tokens"))
        .select(F.col("w.start").alias("window_start"), group, "rows", "tokens")
    )


def drain(rows: DataFrame, out: str, checkpoint: str, transform=None) -> None:
    """Process all that is there and stop.  A batch is written to a folder of its own
    number, so a batch that runs again after a failure replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        (transform(batch) if transform else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
