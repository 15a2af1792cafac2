"""Inventory filters with counters of what each one drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exclusions import exclusion_reason
from ..functions.globs import include_exclude
from ..functions.paths import is_own_footprint, under_root

#: Media extensions.
IMAGES = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tif", "tiff", "ico")
AUDIO = ("mp3", "flac", "wav", "ogg", "m4a", "aac")


def size_range(df: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    return df.where((F.col("size") >= least) & (F.lit(True) if most is None else F.col("size") <= most))


def drop_reason(roots: list[str] = (), least: int = 0, most: int | None = None, include: list[str] = (), exclude: list[str] = (), packs: list[str] = ()) -> Column:
    """NULL for a row that stays, else the first filter that drops it, in the order of the walk."""
    path, size = F.col("path"), F.col("size")
    out = F.when(path.isNull(), "no_path")
    if roots:
        inside = F.lit(False)
        for root in roots:
            inside = inside | under_root(path, F.lit(root))
        out = out.when(~inside, "outside_roots")
    out = out.when(is_own_footprint(path), "own_footprint")
    out = out.when(size.isNull(), "no_metadata").when(size < least, "too_small")
    if most is not None:
        out = out.when(size > most, "too_large")
    if packs:
        out = out.when(exclusion_reason(path, list(packs)).isNotNull(), "excluded")
    return out.when(~include_exclude(path, list(include), list(exclude)), "glob")


def filter_counts(df: DataFrame, reason: Column) -> DataFrame:
    """reason ('kept' for rows that stay), files, bytes: all counters in one pass."""
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def tolerance_match(count_a: Column, count_b: Column, sum_a: Column, sum_b: Column, max_a: Column, max_b: Column) -> Column:
    """Whether two fingerprints of a root are of one state: count and sum within half a percent, equal latest time."""
    near = lambda x, y, floor: F.abs(x - y) <= F.greatest(F.lit(floor), F.call_function("div", F.greatest(x, y), F.lit(200)))
    return near(count_a, count_b, 1) & near(sum_a, sum_b, 1024) & max_a.eqNullSafe(max_b)


def repeated_paths(groups: DataFrame) -> DataFrame:
    """Groups that name a path twice: none, in sound results."""
    return groups.where(F.size(F.array_distinct("files")) < F.size("files"))
