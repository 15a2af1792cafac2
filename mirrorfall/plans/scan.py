"""A whole scan as one lazy plan, and its reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import blocks_read
from ..functions.paths import human_size
from ..operators import filters, groups, keepers
from ..schemas import RESULTS, RESULTS_VERSION, require_version


@dataclass
class ScanConfig:
    """What a scan looks at. Sizes are in bytes; packs are names of exclusion packs."""

    roots: list[str] = field(default_factory=list)
    min_size: int = 0
    max_size: int | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    packs: list[str] = field(default_factory=list)
    reference_roots: list[str] = field(default_factory=list)
    allow_recall: bool = False


@dataclass
class ScanResult:
    inventory: DataFrame
    groups: DataFrame
    members: DataFrame
    skipped: DataFrame
    summary: DataFrame


def scan(inventory: DataFrame, config: ScanConfig) -> ScanResult:
    """Filters, skips what must not be read, groups by content, marks reference members and drops groups of them alone."""
    reason = filters.drop_reason(config.roots, config.min_size, config.max_size, config.include, config.exclude, config.packs)
    kept = inventory.where(reason.isNull())
    skipped = kept.select("path", F.lit("placeholder").alias("reason")).where(F.lit(False))
    if "placeholder" in inventory.columns:
        blocked = blocks_read(F.coalesce("placeholder", F.lit("none")), config.allow_recall)
        skipped = kept.where(blocked).select("path", F.col("placeholder").alias("reason"))
        kept = kept.where(~blocked)
    found = groups.exact_groups(kept)
    members = keepers.mark_references(groups.members(found), config.reference_roots)
    if config.reference_roots:
        members = keepers.drop_reference_only(members, ["size", "content_hash"])
        found = found.join(members.select("size", "content_hash").distinct(), ["size", "content_hash"], "left_semi")
    return ScanResult(kept, found, members, skipped, groups.summary(found))


def report_counters(result: ScanResult) -> DataFrame:
    """One row: inventory_files, groups, files_in_groups, reclaim_bytes."""
    files = result.inventory.agg(F.count("*").alias("inventory_files"))
    return files.crossJoin(result.summary.select("groups", F.col("files").alias("files_in_groups"), "reclaim_bytes"))  # one row each


def csv_rows(result: ScanResult) -> DataFrame:
    """group (from 1), size_bytes, content_hash, path: a row a member."""
    return groups.members(groups.numbered(result.groups)).select(F.col("group_no").alias("group"), F.col("size").alias("size_bytes"), "content_hash", "path")


def json_rows(result: ScanResult) -> DataFrame:
    """A row a group in the results format, each with the schema name, so that large results are written by many tasks."""
    return result.groups.select(F.lit(RESULTS_VERSION).alias("schema"), F.struct("size", "content_hash", "files", F.lit("byte-identical").alias("similarity_kind")).alias("group"))


def write_report(result: ScanResult, path: str, kind: str = "json") -> None:
    """json, csv, or text and markdown (their bounded head only) under `path`."""
    if kind == "json":
        json_rows(result).write.mode("overwrite").json(path)
    elif kind == "csv":
        csv_rows(result).write.mode("overwrite").option("header", True).csv(path)
    elif kind in ("text", "markdown"):
        top = groups.top_reclaim(result.groups).select("rank", "n_files", human_size(F.col("reclaim_bytes")).alias("freed"), F.get("files", F.lit(0)).alias("first"))
        row = result.summary.first()
        head = f"{row.groups} groups, {row.files} files, {row.reclaim_bytes} bytes to free"
        lines = [head, "", *([f"| {r.rank} | {r.n_files} | {r.freed} | {r.first} |" for r in top.orderBy("rank").collect()] if kind == "markdown" else [f"{r.rank}. {r.freed} in {r.n_files} copies of {r.first}" for r in top.orderBy("rank").collect()])]
        spark = result.groups.sparkSession
        spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown report {kind!r}")


def read_results(spark, path: str) -> DataFrame:
    """Groups of a results file or folder, one a row, after a check of the schema name."""
    df = spark.read.schema("schema string, group struct<size:bigint, content_hash:string, files:array<string>, similarity_kind:string>").option("mode", "FAILFAST").json(path)
    return require_version(df, RESULTS_VERSION).select("group.*")


def read_results_document(spark, path: str) -> DataFrame:
    """Groups of a single-document results file (RESULTS)."""
    df = spark.read.schema(RESULTS).option("multiLine", True).json(path)
    return require_version(df, RESULTS_VERSION).select(F.explode("groups").alias("g")).select("g.*")
