"""The driver's tables as inventories, fingerprints and histories, with the same expressions in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import sign_fingerprint
from ..functions.paths import TICKS_TO_EPOCH

AS_OF = 1_704_067_200
_MTIME = f"({AS_OF} - (doc_id * 7919 % 4000) * 86400)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: /source/lang/doc<id>.txt; times and inodes follow from doc_id, two ids share an inode."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.expr("concat('/', source, '/', lang, '/doc', doc_id, '.txt')").alias("path"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.expr(_MTIME).alias("mtime_unix"),
        F.expr(f"{_MTIME} * 10000000 + {TICKS_TO_EPOCH}").alias("mtime_ticks"),
        F.col("source").alias("volume"),
        F.expr("doc_id div 2").alias("file_ref"),
        F.concat(F.lit("/"), "source").alias("root"),
        F.col("doc_id").alias("ordinal"),
        "doc_id",
        F.col("text").alias("content"),
    )


INV = f"""inv AS (SELECT '/' || source || '/' || lang || '/doc' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size,
{_MTIME}::BIGINT AS mtime_unix, ({_MTIME} * 10000000 + {TICKS_TO_EPOCH})::BIGINT AS mtime_ticks, source AS volume,
doc_id // 2 AS file_ref, '/' || source AS root, doc_id AS ordinal, doc_id, text AS content FROM documents)"""

#: Exact groups and their members, as CTEs behind INV.
GROUPS = (
    INV
    + """, hashed AS (SELECT *, sha256(content) AS content_hash FROM inv),
grp AS (SELECT size, content_hash, count(*)::BIGINT AS n_files, min(path) AS first_path, string_agg(path, '|' ORDER BY path) AS files
FROM hashed GROUP BY size, content_hash HAVING count(*) >= 2),
mem AS (SELECT h.* FROM hashed h JOIN grp USING (size, content_hash))"""
)


def member_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the exact groups with everything that keepers and plans need."""
    inv = inventory(spark, sf_dir)
    hashed = inv.withColumn("content_hash", F.sha2("content", 256)).drop("content")
    repeated = hashed.groupBy("size", "content_hash").count().where("count >= 2").select("size", "content_hash")
    return hashed.join(repeated, ["size", "content_hash"], "left_semi")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as id, fp (64 sign bits), size and path, every tenth vector twice as a planted copy."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_fingerprint(F.col("embedding")).alias("fp"), (F.col("label") * 100 + 1000).cast("bigint").alias("size"))
    twins = vectors.where("id % 10 = 0").select((F.col("id") + 1_000_000).alias("id"), F.col("fp").bitwiseXOR(F.lit(5)).alias("fp"), "size")
    return vectors.unionByName(twins).withColumn("path", F.concat(F.lit("/img/"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit(".png")))


#: The sign of element 63 makes the value negative, so the sum is taken in HUGEINT and brought into 64 bits.
FPS = """raw AS (SELECT vec_id AS id, list_sum([CASE WHEN embedding[i + 1] > 0 THEN (1::HUGEINT << i) ELSE 0::HUGEINT END FOR i IN range(64)]) AS u, label FROM embeddings),
base AS (SELECT id, (CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END)::BIGINT AS fp, (label * 100 + 1000)::BIGINT AS size FROM raw),
fps AS (SELECT *, '/img/' || lpad(id::VARCHAR, 8, '0') || '.png' AS path FROM (SELECT * FROM base UNION ALL SELECT id + 1000000, xor(fp, 5::BIGINT), size FROM base WHERE id % 10 = 0))"""
