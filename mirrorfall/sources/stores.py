"""Stores of scan records and checkpoints: folders of JSON lines that readers tolerate damage in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Greatest version of a record that this code reads.
RECORD_VERSION = 1
RECORD = "schema_version int, scan_id bigint, started_at_unix bigint, completed_at_unix bigint, state string, last_attempt_unix bigint, attempts int, roots array<string>, groups bigint, files bigint, reclaim_bytes bigint"
CHECKPOINT = "schema_version int, roots array<string>, stage string, saved_at_unix bigint, done_files bigint, done_bytes bigint, groups bigint"


def _write(rows: DataFrame, path: str, mode: str) -> None:
    rows.withColumn("schema_version", F.lit(RECORD_VERSION)).write.mode(mode).json(path)


def append_history(records: DataFrame, path: str) -> None:
    """Adds scan records (columns of RECORD; missing ones are null) to the store; each call writes files of its own."""
    _write(records, path, "append")


def _tolerant(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    lines = spark.read.text(path).where("trim(value) != ''")
    return lines.withColumn("r", F.from_json("value", ddl, {"mode": "PERMISSIVE"}))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The readable records, one for each scan_id (its latest attempt). Lines that don't parse, have no scan_id or are of a later
    version are left out; history_faults tells them."""
    rows = _tolerant(spark, path, RECORD).where(F.col("r.scan_id").isNotNull() & (F.col("r.schema_version") <= RECORD_VERSION)).select("r.*")
    newest = F.struct(F.coalesce("last_attempt_unix", "completed_at_unix", "started_at_unix").alias("at"), *[F.col(c) for c in rows.columns if c != "scan_id"])
    latest = rows.groupBy("scan_id").agg(F.max(newest).alias("x"))
    return latest.select(*["scan_id" if c == "scan_id" else f"x.{c}" for c in rows.columns])


def history_faults(spark: SparkSession, path: str) -> DataFrame:
    """reason ('unparsable' or 'later-version'), lines: what read_history leaves out."""
    reason = F.when(F.col("r.scan_id").isNull(), "unparsable").when(F.col("r.schema_version") > RECORD_VERSION, "later-version")
    return _tolerant(spark, path, RECORD).select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("lines"))


def delete_scans(spark: SparkSession, path: str, scan_ids: DataFrame, out: str) -> None:
    """Writes the store without the scans of `scan_ids` (scan_id) to the folder `out`, which must not exist."""
    _write(read_history(spark, path).join(scan_ids.select("scan_id").distinct(), "scan_id", "left_anti").drop("schema_version"), out, "errorifexists")


def record_outcomes(history: DataFrame, outcomes: DataFrame, most: int = 3) -> DataFrame:
    """History with submissions' outcomes (scan_id, accepted, at_unix) taken in: accepted scans are done, others stay pending with
    one attempt more until `most`, then failed. Of several outcomes of a scan the latest counts."""
    last = outcomes.groupBy("scan_id").agg(F.max(F.struct("at_unix", "accepted")).alias("o"))
    tried = F.coalesce("attempts", F.lit(0)) + 1
    state = F.when(F.col("o").isNull(), F.col("state")).when(F.col("o.accepted"), "done").when(tried >= most, "failed").otherwise("pending")
    return history.join(last, "scan_id", "left").withColumns({
        "attempts": F.when(F.col("o").isNull(), F.col("attempts")).otherwise(tried), "last_attempt_unix": F.coalesce("o.at_unix", "last_attempt_unix"), "state": state,
    }).drop("o")


def save_checkpoint(summary: DataFrame, survivors: DataFrame, path: str) -> None:
    """Keeps a scan's state: `survivors`, the rows that the last finished stage left, then `summary` (one row of CHECKPOINT). The
    summary is written last, so a checkpoint without one was not finished."""
    survivors.write.mode("overwrite").parquet(f"{path}/survivors")
    _write(summary, f"{path}/summary", "overwrite")


def load_checkpoint(spark: SparkSession, path: str, roots: list[str]) -> tuple[DataFrame, DataFrame] | None:
    """(summary, survivors) of a finished checkpoint of these roots, in any order; None where there is none to resume from."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/summary/_SUCCESS")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = _tolerant(spark, f"{path}/summary", CHECKPOINT).where(F.col("r.schema_version") <= RECORD_VERSION).select("r.*")
    same = F.array_sort(F.array_distinct("roots")) == F.array_sort(F.array_distinct(F.array(*map(F.lit, roots)))) if roots else F.size("roots") == 0
    rows = rows.where(same)
    return None if rows.isEmpty() else (rows, spark.read.parquet(f"{path}/survivors"))
