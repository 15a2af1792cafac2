"""Exact duplicates: size classes, tiers of hashes, groups, identity, and what removing copies would save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bits import TIER2_FLOOR, WINDOW, head_slice, sampled_slice, tier_bytes


def prune_singletons(df: DataFrame, keys: list[str], wide: bool = False) -> DataFrame:
    """Rows whose keys occur twice or more.

    For narrow rows a window counts them in one shuffle. For wide rows (content) the keys are counted first, with partial
    aggregation, and the rows are semi-joined, so content of unique rows is not held in a window's buffer. Nulls in keys are
    equal either way.
    """
    if wide:
        return _prune_null_safe(df, keys)
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n >= 2").drop("__n")


def _prune_null_safe(df: DataFrame, keys: list[str]) -> DataFrame:
    """As prune_singletons for wide rows, where nulls in keys are equal."""
    repeated = df.groupBy(*keys).count().where("count >= 2").select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(repeated, same, "left_semi")


def prune_optional(df: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """Rows without a fingerprint, and those whose fingerprint has a partner under the same keys."""
    n = F.count("*").over(Window.partitionBy(*keys, fingerprint))
    return df.withColumn("__n", n).where(F.col(fingerprint).isNull() | (F.col("__n") >= 2)).drop("__n")


def size_classes(inventory: DataFrame, min_files: int = 2) -> DataFrame:
    """size, n_files for the sizes that several files share; empty files are a class like any other."""
    return inventory.groupBy("size").agg(F.count("*").alias("n_files")).where(F.col("n_files") >= min_files)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def exact_groups(inventory: DataFrame, content: str = "content") -> DataFrame:
    """size, content_hash, n_files, files (sorted paths): one row a group of two or more.

    Hashing runs on the scan's side, so no shuffle carries content.
    """
    hashed = inventory.select("path", "size", content_hash(F.col(content)).alias("content_hash"))
    return hashed.groupBy("size", "content_hash").agg(F.count("*").alias("n_files"), F.sort_array(F.collect_list("path")).alias("files")).where("n_files >= 2")


def numbered(groups: DataFrame) -> DataFrame:
    """Groups with group_no from 1, largest size first, then by their files."""
    return groups.withColumn("group_no", F.row_number().over(Window.orderBy(F.desc("size"), "files")).cast("bigint"))


def members(groups: DataFrame) -> DataFrame:
    """One row a member: the group's columns, ordinal from 0, path."""
    return groups.select(*[c for c in groups.columns if c != "files"], F.posexplode("files").alias("ordinal", "path"))


def tiered(inventory: DataFrame, content: str = "content", tier1_bytes: int = 4096, floor: int = TIER2_FLOOR, window: int = WINDOW) -> dict[str, DataFrame]:
    """Survivors of each tier: size, head, sampled, full, with the tiers' hashes t1, t2, t3 and without content.

    All hashes are made in one pass at the scan, so no shuffle carries content. A tier's rows are counted by their keys with
    partial aggregation and joined, so identical files don't meet in one task.
    """
    c = F.col(content)
    hashes = {"t1": F.sha2(head_slice(c, tier1_bytes), 256), "t2": F.sha2(sampled_slice(c, F.col("size"), floor, window), 256), "t3": F.sha2(c, 256)}
    rows = inventory.withColumns(hashes).drop(content)
    size = prune_singletons(rows, ["size"], wide=True)
    head = prune_singletons(size, ["size", "t1"], wide=True)
    sampled = prune_singletons(head, ["size", "t1", "t2"], wide=True)
    full = prune_singletons(sampled, ["size", "t3"], wide=True)
    return {"size": size, "head": head, "sampled": sampled, "full": full}


def funnel(inventory: DataFrame, tiers: dict[str, DataFrame]) -> DataFrame:
    """stage, files for the inventory and every tier."""
    out = inventory.agg(F.lit("inventory").alias("stage"), F.count("*").alias("files"))
    for name, df in tiers.items():
        out = out.unionByName(df.agg(F.lit(name).alias("stage"), F.count("*").alias("files")))
    return out


def tier_counters(inventory: DataFrame, tiers: dict[str, DataFrame], tier1_bytes: int = 4096, window: int = WINDOW, floor: int = TIER2_FLOOR) -> DataFrame:
    """tier, files and bytes read, and the percentage that the tier removed."""
    size = F.col("size")
    plans = [("head", tiers["size"], tiers["head"], tier_bytes(1, size, tier1_bytes)), ("sampled", tiers["head"].where(size >= floor), None, F.lit(3 * window).cast("bigint")), ("full", tiers["sampled"], tiers["full"], size)]
    out = None
    for name, before, after, read in plans:
        row = before.agg(F.lit(name).alias("tier"), F.count("*").alias("files"), F.coalesce(F.sum(read), F.lit(0)).cast("bigint").alias("bytes_read"))
        left = after.agg(F.count("*").alias("__left")) if after is not None else before.agg(F.lit(None).cast("bigint").alias("__left"))
        row = row.crossJoin(left)  # one row each
        row = row.select("tier", "files", "bytes_read", F.when(F.col("files") > 0, F.round(100.0 * (F.col("files") - F.col("__left")) / F.col("files"), 4)).alias("culled_pct"))
        out = row if out is None else out.unionByName(row)
    return out


def inode_groups(inventory: DataFrame) -> DataFrame:
    """Files with several names: volume, file_ref, n_links, first_path."""
    known = inventory.where("file_ref is not null")
    return known.groupBy("volume", "file_ref").agg(F.count("*").alias("n_links"), F.min("path").alias("first_path"), F.max("size").alias("size")).where("n_links >= 2")


def identity_groups(inventory: DataFrame, content: str = "content") -> DataFrame:
    """Content groups with n_files, unique_inodes and link_equivalent (all names are of one file)."""
    hashed = inventory.select("path", "size", "volume", "file_ref", content_hash(F.col(content)).alias("content_hash"))
    inode = F.coalesce(F.concat_ws(":", "volume", "file_ref"), F.col("path"))
    out = hashed.groupBy("size", "content_hash").agg(F.count("*").alias("n_files"), F.count_distinct(inode).alias("unique_inodes"), F.min("path").alias("first_path"))
    return out.where("n_files >= 2").withColumn("link_equivalent", F.col("unique_inodes") == 1)


def savings(size: Column, n_files: Column, unique_inodes: Column, link_equivalent: Column) -> Column:
    """Bytes that one copy less for each further inode would free; nothing where all names are of one file."""
    copies = F.when(unique_inodes > 0, unique_inodes).otherwise(n_files)
    return F.when(link_equivalent, F.lit(0)).otherwise((copies - 1) * size).cast("bigint")


def summary(groups: DataFrame) -> DataFrame:
    """One row: groups, files, reclaim_bytes by path, and inode_reclaim_bytes where inodes are known."""
    by_path = (F.col("n_files") - 1) * F.col("size")
    inode = savings(F.col("size"), F.col("n_files"), F.col("unique_inodes"), F.col("link_equivalent")) if "unique_inodes" in groups.columns else by_path
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return groups.agg(F.count("*").alias("groups"), total(F.col("n_files")).alias("files"), total(by_path).alias("reclaim_bytes"), total(inode).alias("inode_reclaim_bytes"))


def top_reclaim(groups: DataFrame, limit: int = 10) -> DataFrame:
    """The groups that would free most, ranked; a report's head, so its limit is the feature."""
    ranked = groups.withColumn("reclaim_bytes", ((F.col("n_files") - 1) * F.col("size")).cast("bigint"))
    head = ranked.orderBy(F.desc("reclaim_bytes"), "content_hash").limit(limit)
    return head.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("reclaim_bytes"), "content_hash")).cast("bigint"))


def size_bucket(size: Column) -> Column:
    out = F.lit(">100MB")
    for label, limit in reversed((("<10KB", 10_000), ("<100KB", 100_000), ("<1MB", 1_000_000), ("<10MB", 10_000_000), ("<100MB", 100_000_000))):
        out = F.when(size < limit, label).otherwise(out)
    return out


def size_histogram(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy(size_bucket(F.col("size")).alias("bucket")).agg(F.count("*").alias("n_files"), F.sum("size").cast("bigint").alias("bytes"))


def size_signature(inventory: DataFrame) -> DataFrame:
    """One row: a digest over the sorted (bucket, count) pairs."""
    pairs = size_histogram(inventory).select(F.concat_ws("=", "bucket", "n_files").alias("x"))
    return pairs.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("x")), ";"), 256).alias("signature"))


def candidate_bytes(inventory: DataFrame) -> DataFrame:
    return size_classes(inventory).agg(F.coalesce(F.sum(F.col("size") * F.col("n_files")), F.lit(0)).cast("bigint").alias("candidate_bytes"))


def reclaim_ceiling(groups: DataFrame, measured: int) -> DataFrame:
    """One row: what exact groups could free at most, and measured / ceiling within 0 and 1."""
    ceiling = F.coalesce(F.sum((F.col("n_files") - 1) * F.col("size")), F.lit(0)).cast("bigint")
    out = groups.agg(ceiling.alias("ceiling_bytes"))
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(float(measured)) / F.col("ceiling_bytes")))
    return out.withColumn("efficiency", F.when(F.col("ceiling_bytes") > 0, ratio).otherwise(F.lit(0.0)))


def distinct_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; later roots' repeats go."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def union_kinds(**groups: DataFrame) -> DataFrame:
    """Groups of several kinds under one schema, with similarity_kind."""
    out = None
    for kind, df in groups.items():
        df = df.withColumn("similarity_kind", F.lit(kind.replace("_", "-")))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def similarity_breakdown(groups: DataFrame) -> DataFrame:
    return groups.groupBy("similarity_kind").agg(F.count("*").alias("n_groups"))


def treemap_weights(groups: DataFrame) -> DataFrame:
    """Groups that would free something, with their share of the whole."""
    freed = groups.withColumn("weight", ((F.col("n_files") - 1) * F.col("size")).cast("bigint")).where("weight > 0")
    whole = freed.agg(F.sum("weight").alias("__all"))  # one row
    return freed.join(F.broadcast(whole)).withColumn("share", F.col("weight") / F.col("__all")).drop("__all")
