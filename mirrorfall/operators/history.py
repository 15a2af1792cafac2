"""Scan history, pending actions, throughput, root fingerprints, run shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest_first(history: DataFrame, limit: int | None = None) -> DataFrame:
    out = history.orderBy(F.desc("started_at"), F.desc("scan_id"))
    return out if limit is None else out.limit(limit)


def pending_older_than(history: DataFrame, cutoff: Column) -> DataFrame:
    """Pending records whose last attempt, else completion, else start is at or before the cutoff."""
    return history.where((F.col("state") == "pending") & (F.coalesce("last_attempt", "completed_at", "started_at") <= cutoff))


def prune(history: DataFrame, as_of: Column, retention_seconds: int) -> DataFrame:
    """Records within the retention; 0 keeps all."""
    if not retention_seconds:
        return history
    return history.where(F.unix_timestamp("started_at") >= F.unix_timestamp(as_of) - retention_seconds)


def retry_state(attempts: Column, most: int = 3) -> Column:
    return F.when(attempts >= most, "failed").otherwise("pending")


def pending_sums(actions: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """key, bytes of actions no older than `days`."""
    fresh = actions.where(F.unix_timestamp("ts") >= F.unix_timestamp(as_of) - days * 86400)
    return fresh.groupBy("key").agg(F.sum("bytes").alias("bytes"))


def merge_sums(a: Column, b: Column) -> Column:
    """Two maps of sums added by key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def throughput(samples: DataFrame, seconds: int = 1) -> DataFrame:
    """Samples (drive, t in microseconds, bytes) with the trailing window's sum and the running peak of it."""
    w = Window.partitionBy("drive").orderBy("t").rangeBetween(-seconds * 1_000_000, 0)
    running = Window.partitionBy("drive").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("window_bytes", F.sum("bytes").over(w)).withColumn("peak_bytes", F.max("window_bytes").over(running))


def root_fingerprint(inventory: DataFrame, root: str = "root") -> DataFrame:
    return inventory.groupBy(root).agg(F.count("*").alias("files"), F.sum("size").cast("bigint").alias("bytes"), F.max("mtime_ticks").alias("latest"))


def cumulative(sessions: DataFrame) -> DataFrame:
    """Sessions (session_no, bytes, files) with running totals; history is one row a scan."""
    w = Window.orderBy("session_no").rowsBetween(Window.unboundedPreceding, 0)
    return sessions.withColumns({"total_bytes": F.sum("bytes").over(w), "total_files": F.sum("files").over(w)})


def lifecycle(total: Column, walk: Column, start: Column, is_first: Column) -> list[Column]:
    """ttws, ttw and ttdd, which add up to the total; only a first scan has a time to its start."""
    ttws = F.when(is_first, start).otherwise(F.lit(0))
    return [ttws.alias("ttws"), walk.alias("ttw"), (total - ttws - walk).alias("ttdd")]


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.greatest(done / total, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def resume_tier(has_marker: Column, has_inventory: Column, same_roots: Column, fresh: Column, groups: Column) -> Column:
    return (
        F.when(~has_marker | ~same_roots, "fresh")
        .when(~has_inventory, "marker")
        .when(~fresh, "warm")
        .when(groups > 0, "full")
        .otherwise("inventory-only")
    )


def worker_skew(rows: DataFrame) -> DataFrame:
    """files and bytes of each partition, with its share of the largest."""
    by = rows.groupBy(F.spark_partition_id().alias("worker")).agg(F.count("*").alias("files"), F.sum("size").cast("bigint").alias("bytes"))
    return by.withColumn("active_pct", 100.0 * F.col("bytes") / F.max("bytes").over(Window.partitionBy()))
