"""Synthetic corpora with known duplicates, audits against them, digests and Merkle roots, deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import kept

LEAF = 1 << 20


def corpus_plan(spark: SparkSession, files: int, set_size: int = 3, share: int = 4, sizes: tuple[int, ...] = (4096, 1 << 20, 1 << 28)) -> DataFrame:
    """index, size, content_id: every `share`-th run of `set_size` files is one duplicate set, the others are unique."""
    run = F.call_function("div", F.col("id"), F.lit(set_size))
    is_set = run % share == 0
    size = F.element_at(F.array(*[F.lit(s) for s in sizes]), (run % len(sizes) + 1).cast("int"))
    return spark.range(files).select(F.col("id").alias("index"), size.cast("bigint").alias("size"), F.when(is_set, run * set_size).otherwise(F.col("id")).alias("content_id"))


def dupsets(plan: DataFrame) -> DataFrame:
    """size, content_id, n, members (sorted indices, as text) of the sets of two files and more."""
    by = plan.groupBy("size", "content_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("index")).alias("m")).where("n >= 2")
    return by.select("size", "content_id", "n", F.array_join("m", ",").alias("members"))


def class_stats(classes: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Size classes (file_size, file_count, pairs, big_sets, big_size) with dups, originals, leaves, dup_bytes and total_bytes."""
    c = F.col
    dups = c("pairs") + c("big_sets") * F.greatest(c("big_size") - 1, F.lit(0))
    return classes.withColumn("dups", dups.cast("bigint")).withColumns({
        "originals": (c("file_count") - c("dups")).cast("bigint"), "leaves": (c("file_count") * F.ceil(c("file_size") / leaf)).cast("bigint"),
        "dup_bytes": (c("dups") * c("file_size")).cast("bigint"), "total_bytes": (c("file_count") * c("file_size")).cast("bigint"),
    })


def reclaimable_fraction(stats: DataFrame) -> DataFrame:
    return stats.agg((F.sum("dup_bytes").cast("double") / F.sum("total_bytes")).alias("fraction"))


def largest_dupset(sets: DataFrame, n: str = "n") -> DataFrame:
    return sets.agg(F.coalesce(F.max(n), F.lit(0)).cast("bigint").alias("largest"))


def audit(plan: DataFrame, hashes: DataFrame) -> DataFrame:
    """content_id, members, missing, distinct_hashes of the sets whose files are missing or disagree."""
    sets = plan.withColumn("__n", F.count("*").over(Window.partitionBy("content_id"))).where("__n >= 2")
    joined = sets.join(hashes, "index", "left")
    by = joined.groupBy("content_id").agg(F.count("*").alias("members"), F.count_if(F.col("hash").isNull()).alias("missing"), F.count_distinct("hash").alias("distinct_hashes"))
    return by.where("missing > 0 or distinct_hashes > 1")


def diff_hashes(*methods: DataFrame) -> DataFrame:
    """index and each method's hash where they are not all equal; methods are (index, hash)."""
    out = methods[0].withColumnRenamed("hash", "h0")
    for k, df in enumerate(methods[1:], 1):
        out = out.join(df.withColumnRenamed("hash", f"h{k}"), "index", "full_outer")
    odd = F.lit(False)
    for k in range(1, len(methods)):
        odd = odd | ~F.col(f"h{k}").eqNullSafe(F.col("h0"))
    return out.where(odd)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "path", value: str = "digest") -> DataFrame:
    """key and change: added, removed or changed."""
    joined = before.select(key, F.col(value).alias("b"), F.lit(True).alias("in_b")).join(after.select(key, F.col(value).alias("a"), F.lit(True).alias("in_a")), key, "full_outer")
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return joined.select(key, change.alias("change")).where("change is not null")


def leaves(files: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Each file's pieces of at most `leaf` bytes: index, offset, length; an empty file has none."""
    offsets = F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(leaf).cast("bigint")))
    out = files.select("index", "size", F.explode(offsets).alias("offset"))
    return out.select("index", "offset", F.least(F.lit(leaf), F.col("size") - F.col("offset")).cast("bigint").alias("length"))


def merkle_root(rows: DataFrame, at: str = "position", value: str = "leaf") -> DataFrame:
    """One row, root: leaves hashed with a 0x00 in front and inner nodes with a 0x01; an odd last node goes up as it is.

    Every level is one aggregation on position div 2, so no task sees more than pairs.
    """
    level = rows.select(F.col(at).cast("bigint").alias("p"), F.sha2(F.concat(F.unhex(F.lit("00")), F.col(value).cast("binary")), 256).alias("h"))
    count = level.count()
    while count > 1:
        pair = F.struct(F.pmod("p", F.lit(2)).alias("s"), "h")
        up = level.groupBy(F.call_function("div", F.col("p"), F.lit(2)).alias("p")).agg(F.sort_array(F.collect_list(pair)).alias("x"))
        joined = F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(F.get("x", F.lit(0))["h"]), F.unhex(F.get("x", F.lit(1))["h"])), 256)
        level = up.select("p", F.when(F.size("x") == 2, joined).otherwise(F.get("x", F.lit(0))["h"]).alias("h"))
        count = (count + 1) // 2
        level = kept(level) if count > 4096 else level
    return level.select(F.col("h").alias("root"))


def result_digest(sets: DataFrame) -> DataFrame:
    """One row: digest over the sets in the order of their members, each as size and members."""
    lines = sets.select(F.concat_ws(":", F.col("n").cast("string"), "members").alias("x"))
    return lines.agg(F.sha2(F.concat(F.lit("dupsets|"), F.count("*").cast("string"), F.lit("|"), F.array_join(F.sort_array(F.collect_list("x")), ";")), 256).alias("digest"))


def sample(spark: SparkSession, seed: str, n: int, wanted: int) -> DataFrame:
    """`wanted` distinct numbers below n: the first distinct values of a keyed digest's sequence; sampling is the feature."""
    if wanted > n:
        raise ValueError("cannot draw more distinct numbers than there are")
    draws = wanted * 4 + 64
    while True:
        value = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit("sample"), F.lit(seed), F.col("id")), 256), 1, 12), 16, 10).cast("bigint") % n
        first = spark.range(draws).select("id", value.alias("value")).groupBy("value").agg(F.min("id").alias("k"))
        if first.count() >= wanted:
            return first.orderBy("k").limit(wanted).select("k", "value")
        draws *= 4
