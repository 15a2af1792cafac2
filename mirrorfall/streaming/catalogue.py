"""Streaming queries over the events table, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import kept
from .incremental import suppress_repeats, windowed_bytes


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("bytes"))


def _finish(stream: DataFrame, mode: str) -> DataFrame:
    spark = stream.sparkSession
    kept(spark.range(0))  # makes sure that the shared folder is named
    folder = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/mirrorfall-stream-{uuid.uuid4().hex[:12]}"

    def emit(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{folder}/out")
        else:
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(emit).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _finish(windowed_bytes(_events(spark, sf_dir), "ts", "event_type", "1 hour"), "complete")
    return out.select("event_type", F.unix_micros("window_start").alias("window_us"), "n", "bytes")


def stream_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _finish(suppress_repeats(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "60 days"), "append")
    return out.select("user_id", "event_type")


QUERIES = {"stream_throughput": stream_throughput, "stream_suppressed": stream_suppressed}
ORACLE_SQL = {
    "stream_throughput": "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_us, count(*)::BIGINT AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS bytes FROM events GROUP BY 1, 2",
    "stream_suppressed": "SELECT DISTINCT user_id, event_type FROM events",
}
