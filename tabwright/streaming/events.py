"""Event logs and arriving files as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.operators.audit import SLOW_REQUEST_MS
from tabwright.operators.scan import scan_files, scan_texts


def windowed_metrics(
    events: DataFrame, at: str, key: Column, duration_ms: Column, window: str = "1 hour", late: str = "10 minutes",
    slow_ms: float = SLOW_REQUEST_MS,
) -> DataFrame:
    """(window_start, key, requests, slow) per tumbling window; batch or stream.

    On a stream, events older than the watermark are dropped and state is kept
    only for open windows.
    """
    events = events.withColumn(at, F.col(at).cast("timestamp"))
    source = events.withWatermark(at, late) if events.isStreaming else events
    return (
        source.groupBy(F.window(at, window).alias("w"), key.alias("key"))
        .agg(F.count(F.lit(1)).alias("requests"), F.count_if(duration_ms >= slow_ms).alias("slow"))
        .select(F.col("w.start").alias("window_start"), "key", "requests", "slow")
    )


def with_open_windows(
    closed: DataFrame, events: DataFrame, at: str, key: Column, duration_ms: Column, window: str = "1 hour",
    slow_ms: float = SLOW_REQUEST_MS,
) -> DataFrame:
    """All windows of a drained stream: those that its sink holds and those still open.

    An append sink gets a window when the watermark has passed it, so the last
    ones of a finished stream are missing. They are counted from the events that
    lie at or after the end of the last closed window.
    """
    last = closed.agg((F.max("window_start") + F.expr(f"INTERVAL {window}")).alias("end")).first()["end"]
    rest = events if last is None else events.where(F.col(at) >= F.lit(last))
    return closed.unionByName(windowed_metrics(rest, at, key, duration_ms, window, slow_ms=slow_ms))


def dedup_on_arrival(files: DataFrame, at: str, file_hash: str = "file_hash", late: str = "1 hour") -> DataFrame:
    """The first arrival of each content hash within the watermark."""
    if files.isStreaming:
        timed = files.withColumn(at, F.col(at).cast("timestamp"))
        return timed.withWatermark(at, late).dropDuplicatesWithinWatermark([file_hash])
    return files.dropDuplicates([file_hash])


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of whole CSV files as they land in a folder."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.csv")
        .load(folder)
    )


def scan_arriving(files: DataFrame, out: str, checkpoint: str):
    """Scan arriving files and append their records; one exactly-once file sink."""
    return (
        scan_files(files)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", out)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def scan_batches(texts: DataFrame, keys: list[str], text: str, out: str, checkpoint: str):
    """Scan a stream of texts batch by batch.

    A batch overwrites its own folder, so a repeated batch leaves no double rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        scan_texts(batch, keys, F.col(text)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        texts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
