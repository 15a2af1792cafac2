"""Table schemas and the check that a stored table has the version that its reader expects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INVENTORY = "path string, size bigint, mtime_ticks bigint, volume string, file_ref bigint, parent_ref bigint, usn bigint, attributes bigint, placeholder string, root string"
HASH_CACHE = "volume string, file_ref bigint, hash_algo string, tier1_bytes bigint, size bigint, mtime_ticks bigint, usn bigint, t0 binary, t1 binary, t2 binary, t3 binary, last_seen bigint"
RESULTS = "schema string, groups array<struct<size:bigint, content_hash:string, files:array<string>, link_equivalent:boolean, unique_inodes:bigint, similarity_kind:string, file_sizes:array<bigint>>>, skipped array<struct<path:string, reason:string>>, reference_paths array<string>, summary struct<groups:bigint, files:bigint, reclaim_bytes:bigint>"
RECEIPT = "group_id bigint, ordinal bigint, path string, keeper_path string, action string, outcome string, size_bytes bigint"
RESULTS_VERSION = "mirrorfall.scan.v1"


class SchemaMismatch(ValueError):
    """A stored table's schema name or version is not the one that its reader knows."""


def require_version(df: DataFrame, expected: str, column: str = "schema") -> DataFrame:
    """df, or SchemaMismatch where a row has another name or version."""
    other = df.where(~F.col(column).eqNullSafe(F.lit(expected))).select(column).head(1)
    if other:
        raise SchemaMismatch(f"expected {expected}, found {other[0][0]}")
    return df
