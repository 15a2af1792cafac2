"""Contiguous shards of nearly equal bytes, cut from a global prefix sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialize

PER_ROW_BYTES = 8


def shard_by_bytes(rows: DataFrame, size: Column, order: list[Column], shards: int, partitions: int | None = None) -> DataFrame:
    """Adds `size`, `shard` and `slot` to `rows`.

    The rows are range-partitioned by `order`, each partition sums its sizes, and the running total of the
    partitions' sums turns local prefix sums into global ones. A row whose middle byte lies in the k-th of `shards`
    equal stretches of the total goes to shard k, so a shard is a contiguous run and misses its target by at most
    one row's size at either end. `slot` counts a shard's rows from 0 without gaps, in that order.

    Ties in `order`, such as repeated rows, are dealt by their place in the input: equal keys may hold any share of
    the rows, for the place is part of the range key. Sizes must not be negative; an empty table gives no rows.
    """
    spark = rows.sparkSession
    parts = partitions or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [f"__k{i}" for i in range(len(order))]
    local = Window.partitionBy("__part").orderBy(*keys, "__place")
    placed = (
        rows.withColumns({"size": size, **dict(zip(keys, order, strict=True))})
        .withColumn("__place", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys, "__place")
        .withColumn("__part", F.spark_partition_id())
    )
    # The partitions' bounds come from a sample, so the dealt rows are kept before anything is counted in them.
    placed = materialize(placed, "shard-rows")
    summed = materialize(
        placed.withColumn("__before", F.sum("size").over(local) - F.col("size")).withColumn("__row", F.row_number().over(local) - F.lit(1).cast("long")).drop(*keys, "__place"),
        "shard-sums",
    )
    totals = placed.groupBy("__part").agg(F.sum("size").alias("__bytes"), F.count("*").alias("__rows"))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    everything = Window.partitionBy()
    starts = totals.select(
        "__part",
        F.coalesce(F.sum("__bytes").over(upto), F.lit(0)).alias("__bytes_before"),
        F.coalesce(F.sum("__rows").over(upto), F.lit(0)).alias("__rows_before"),
        F.sum("__bytes").over(everything).alias("__total"),
    )
    middle = 2 * (F.col("__bytes_before") + F.col("__before")) + F.col("size")
    dealt = summed.join(F.broadcast(starts), "__part").select(  # at most `parts` rows
        *[c for c in summed.columns if not c.startswith("__")],
        F.least(F.lit(shards - 1), F.call_function("div", middle * shards, 2 * F.greatest(F.col("__total"), F.lit(1)))).cast("int").alias("shard"),
        (F.col("__rows_before") + F.col("__row")).alias("__rank"),
    )
    firsts = dealt.groupBy("shard").agg(F.min("__rank").alias("__first"))  # at most `shards` rows
    return dealt.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("__rank") - F.col("__first")).drop("__rank", "__first")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in shards 0 to 23 of nearly equal bytes, in the order of doc_id and text checksum.

    A null text has size 8 and the checksum of no bytes, 0; a null doc_id sorts first; repeated rows each get a slot.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + PER_ROW_BYTES).cast("long").alias("__size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = shard_by_bytes(slim, F.col("__size"), [F.col("doc_id"), F.col("text_crc32")], 24)
    return out.select("doc_id", F.col("size").cast("long"), "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
