"""A training corpus in five stages: toxicity, repeated lines, near duplicates, benchmark passages, token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorfall.llm import decontam, lines, neardups, pieces, toxicity
from mirrorfall.llm._shared import drop, fresh, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half. The model is fitted on the given documents' labels; where none is
    usable, there is no model and all documents stay. Null and empty texts have the score of the bias alone; repeated rows
    go or stay together."""
    model = toxicity.fitted(spark, docs, sf_dir)
    if not len(model[0]) and not model[2]:
        return docs
    name = fresh("__score", docs.columns)
    return toxicity.score(docs, model, name=name).where(F.col(name) < 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; those with no line left go. Texts without a word stay; rows that
    repeat an id do not remove each other's lines."""
    return lines.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that of the least id; null ids come last, then the text hash decides.

    Texts are compared, not ids, so rows that share an id or have none are near duplicates like any others. Texts without
    words are no duplicates; of rows that repeat an id and text, one stays.
    """
    hashed = F.xxhash64("text")
    found = neardups.near_duplicates(docs.select(hashed.alias("doc_id"), "text")).where("n_shingles > 0").groupBy("doc_id").agg(F.min("component_id").alias("component"))
    owners = docs.groupBy(hashed.alias("of")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), hashed.alias("of"))).alias("own"))
    kept = owners.join(found, F.col("of") == found["doc_id"]).groupBy("component").agg(F.min("own").alias("own"))
    id_, of = fresh("__id", docs.columns), fresh("__of", docs.columns)
    kept = materialize(kept.select(F.col("own.id").alias(id_), F.col("own.of").alias(of)), "stage-kept")
    joined = docs.join(kept, docs["doc_id"].eqNullSafe(kept[id_]) & (F.xxhash64(docs["text"]) == kept[of]), "left")
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return joined.where(F.col(of).isNotNull() | wordless).select(*docs.columns).dropDuplicates(["doc_id", "text"])


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and an empty benchmark drops nothing."""
    hits = decontam.match(docs.select(F.struct(*docs.columns).alias("row"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.where(F.size("hits") == 0).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document left: doc_id, n_tokens, ids, round_trip. A null text has null ids."""
    return pieces.encode(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", "n_tokens", "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("sentencepiece", encode),
]

#: SQL can't express the classifier or the encoder; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table, each one's rows written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
        before = docs
    return docs
