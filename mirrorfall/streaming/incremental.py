"""Incremental operators on Structured Streaming: suppression, windows, stale rows, groups by batch, change feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cache import merge_changes


def suppress_repeats(stream: DataFrame, keys: list[str], event_time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key; state is dropped once the watermark has passed it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_bytes(stream: DataFrame, event_time: str, key: str, length: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """key, window_start, n, bytes over tumbling or sliding windows."""
    marked = stream if delay is None else stream.withWatermark(event_time, delay)
    window = F.window(event_time, length, slide) if slide else F.window(event_time, length)
    return marked.groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum("bytes").cast("bigint").alias("bytes")).select(key, F.col("w.start").alias("window_start"), "n", "bytes")


def sessions(stream: DataFrame, event_time: str, key: str, gap: str, delay: str) -> DataFrame:
    """key, session_start, session_end, n: runs of rows no further apart than `gap`."""
    marked = stream.withWatermark(event_time, delay)
    return marked.groupBy(F.session_window(event_time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def drop_stale(stream: DataFrame, event_time: str, as_of: F.Column, days: int = 30) -> DataFrame:
    return stream.where(F.unix_timestamp(event_time) >= F.unix_timestamp(as_of) - days * 86400)


def write_batches(stream: DataFrame, folder: str, make: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """make(batch) of every micro-batch under folder/batch=<n>; a batch that is run again replaces its own folder."""

    def emit(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_changes(spark: SparkSession, changes: DataFrame, snapshot: DataFrame, folder: str, checkpoint: str, key: str = "file_ref", order: str = "usn") -> StreamingQuery:
    """Applies a change feed to a snapshot kept in folder/v=<batch>: each batch reads the version before it, so a batch that is
    run again gives the same version."""

    def merge(batch: DataFrame, number: int) -> None:
        before = snapshot if number == 0 else spark.read.parquet(f"{folder}/v={number - 1}")
        merge_changes(before, batch, key, order).write.mode("overwrite").parquet(f"{folder}/v={number}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
