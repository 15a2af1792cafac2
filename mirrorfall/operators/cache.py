"""Hash cache, warm inventories, parent chains, resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import kept

KEY = ["volume", "file_ref", "hash_algo"]


def drift(found: Column, pairs: list[tuple[str, Column, Column]]) -> Column:
    """no-row, hit, or drift-<axis> for the first of the axes that differs."""
    out = F.when(~found, "no-row")
    for name, now, then in pairs:
        out = out.when(~now.eqNullSafe(then), f"drift-{name}")
    return out.otherwise("hit")


def cache_lookup(inventory: DataFrame, cache: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Inventory rows with `outcome` and the cached tiers of the hits. One join, never a lookup a row."""
    then = cache.select(*keys, F.lit(True).alias("__found"), *[F.col(c).alias(f"__{c}") for c in ("size", "mtime_ticks", "usn", "t1", "t2", "t3")])
    joined = inventory.join(then, keys, "left")
    found = F.coalesce("__found", F.lit(False))
    out = joined.withColumn("outcome", drift(found, [(n, F.col(c), F.col(f"__{c}")) for n, c in (("size", "size"), ("mtime", "mtime_ticks"), ("usn", "usn"))]))
    tiers = {t: F.when(F.col("outcome") == "hit", F.col(f"__{t}")) for t in ("t1", "t2", "t3")}
    return out.withColumns(tiers).select(*inventory.columns, "outcome", *tiers)


def with_identity(inventory: DataFrame) -> DataFrame:
    """Fills the parts of the key that a file system didn't give: one name for unknown volumes, 60 bits of the path's digest for a
    null or zero file_ref."""
    made = F.conv(F.substring(F.sha2("path", 256), 1, 15), 16, 10).cast("bigint")
    known = F.coalesce("file_ref", F.lit(0)) != 0
    return inventory.withColumns({"volume": F.coalesce("volume", F.lit("_unknown_volume")), "file_ref": F.when(known, F.col("file_ref")).otherwise(made)})


def outcome_counts(looked_up: DataFrame) -> DataFrame:
    return looked_up.groupBy("outcome").agg(F.count("*").alias("n"))


def cache_upsert(cache: DataFrame, fresh: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The cache after `fresh`: new hashes win, older tiers stay only while size, time and usn are those they were made of."""
    old, new = cache.alias("o"), fresh.alias("n")
    joined = old.join(new, keys, "full_outer")
    same = F.lit(True)
    for c in ("size", "mtime_ticks", "usn"):
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    is_new = F.coalesce(F.col("n.size"), F.col("n.mtime_ticks"), F.col("n.usn")).isNotNull()
    state = [F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("size", "mtime_ticks", "usn")]
    tiers = [F.when(~is_new, F.col(f"o.{t}")).otherwise(F.coalesce(F.col(f"n.{t}"), F.when(same, F.col(f"o.{t}")))).alias(t) for t in ("t1", "t2", "t3")]
    return joined.select(*keys, *state, *tiers)


def merge_changes(snapshot: DataFrame, changes: DataFrame, key: str = "file_ref", order: str = "usn") -> DataFrame:
    """The snapshot after a change feed (key, order, deleted, and the snapshot's columns): each key's last change decides."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    last = changes.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    untouched = snapshot.join(last.select(key), key, "left_anti")
    return untouched.unionByName(last.where(~F.col("deleted")).select(*snapshot.columns))


def warm_fallback(stored_journal: Column, journal: Column, stored_usn: Column, first_usn: Column, next_usn: Column, unknown_parents: Column) -> Column:
    """NULL where a snapshot can be brought up to date, else why it must be built anew."""
    return (
        F.when(stored_journal.isNull(), "no_snapshot")
        .when(stored_journal != journal, "journal_replaced")
        .when(stored_usn < first_usn, "journal_truncated")
        .when(stored_usn > next_usn, "cursor_ahead")
        .when(unknown_parents > 0, "unknown_parent")
    )


def resume(pending: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What of `pending` is not in `done`."""
    return pending.join(done.select(*keys).distinct(), keys, "left_anti")


def parent_paths(records: DataFrame, max_hops: int = 1024) -> DataFrame:
    """file_ref, path, hops and status of every record (file_ref, parent_ref, name); a root is its own parent or has none.

    Pointer jumping: each round joins every open chain with its ancestor's chain, so n hops take about log2(n) rounds.
    Status is ok, missing_parent, or cycle for chains that never end.
    """
    root = F.col("parent_ref").isNull() | (F.col("parent_ref") == F.col("file_ref"))
    state = kept(records.select("file_ref", F.col("name").alias("path"), F.lit(0).cast("bigint").alias("hops"), F.when(~root, F.col("parent_ref")).alias("next"), F.lit("ok").alias("status")))
    rounds = max(1, max_hops).bit_length() + 1
    for _ in range(rounds):
        if state.where("next is not null").isEmpty():
            break
        above = state.select(F.col("file_ref").alias("next"), F.col("path").alias("__path"), F.col("hops").alias("__hops"), F.col("next").alias("__next"), F.col("status").alias("__status"), F.lit(True).alias("__found"))
        joined = state.join(above, "next", "left")
        met = F.col("next").isNotNull()
        lost = met & F.col("__found").isNull()
        state = kept(
            joined.select(
                "file_ref",
                F.when(met & ~lost, F.concat_ws("/", "__path", "path")).otherwise(F.col("path")).alias("path"),
                (F.col("hops") + F.when(met & ~lost, F.col("__hops") + 1).otherwise(0)).alias("hops"),
                F.when(met & ~lost, F.col("__next")).alias("next"),
                F.when(lost, "missing_parent").when(met, F.col("__status")).otherwise(F.col("status")).alias("status"),
            )
        )
    return state.select("file_ref", F.when(F.col("next").isNull(), F.col("path")).alias("path"), "hops", F.when(F.col("next").isNotNull(), "cycle").otherwise(F.col("status")).alias("status"))


class HashCache:
    """A cache table in versioned folders: every write makes a new version, so a reader never sees half of one."""

    def __init__(self, spark, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def read(self) -> DataFrame | None:
        found = self._versions()
        return self.spark.read.parquet(f"{self.folder}/v{found[-1]}") if found else None

    def write(self, fresh: DataFrame) -> None:
        old, found = self.read(), self._versions()
        out = fresh if old is None else cache_upsert(old, fresh)
        out.write.parquet(f"{self.folder}/v{(found[-1] if found else 0) + 1}")

    def vacuum(self) -> int:
        """Removes all versions but the last; how many."""
        gone = self._versions()[:-1]
        for v in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v{v}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(gone)

    def info(self) -> dict[str, int]:
        now = self.read()
        return {"versions": len(self._versions()), "rows": 0 if now is None else now.count()}
