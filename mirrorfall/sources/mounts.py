"""Mount tables and the mount that a path lies on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File systems by what they mean for deduplication.
NETWORK = ("nfs", "nfs4", "cifs", "smb3", "smbfs", "9p", "fuse.sshfs", "ceph", "glusterfs")
REFLINK = ("btrfs", "xfs", "bcachefs", "ocfs2")
POOL_DEDUP = ("zfs", "btrfs")


def read_mounts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a mount table: ordinal, device, mountpoint, fstype, options; octal escapes are resolved."""
    lines = spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id())
    parts = F.split("value", r"\s+")
    clean = lambda c: F.replace(F.replace(c, F.lit("\\040"), F.lit(" ")), F.lit("\\011"), F.lit("\t"))
    rows = lines.where(F.size(parts) >= 4)
    return rows.select("ordinal", clean(F.get(parts, F.lit(0))).alias("device"), clean(F.get(parts, F.lit(1))).alias("mountpoint"), F.get(parts, F.lit(2)).alias("fstype"), F.get(parts, F.lit(3)).alias("options"))


def mount_flags(fstype: Column, device: Column) -> Column:
    return F.array_compact(F.array(F.when(fstype.isin(*NETWORK), "network"), F.when(device.startswith("/dev/mapper/"), "mapped"), F.when(fstype.isin(*REFLINK), "reflink"), F.when(fstype.isin(*POOL_DEDUP), "pool-dedup")))


def longest_mount(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """path, mountpoint, fstype: the longest mountpoint over the path, the last one of equal length.

    Paths are cut into their prefixes and joined on equality with the mount points, so neither side is held whole.
    """
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    prefixes = F.concat(F.array(F.lit("/")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    points = mounts.select(F.when(F.col("mountpoint") == "/", "/").otherwise(F.regexp_replace("mountpoint", "/+$", "")).alias("prefix"), "mountpoint", "fstype", "ordinal")
    met = paths.select("path", F.explode(F.array_distinct(prefixes)).alias("prefix")).join(points, "prefix")
    best = F.max_by(F.struct("mountpoint", "fstype"), F.struct(F.octet_length("prefix"), "ordinal"))
    return met.groupBy("path").agg(best.alias("m")).select("path", "m.*")


