"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import give_back, map_text, mix, ship, sorted_unique, span_hashes, utf8_parts, word_spans

#: Feature hash bits; weights and training state are bounded by 2**BITS coordinates.
BITS = 20
#: Most labelled documents that the model is fitted on.
MAX_TRAIN_DOCS = 16_000
#: Most feature coordinates (four bytes each) of these documents together; those with the smallest id hashes come first.
MAX_TRAIN_FEATURES = 48 << 20
EPOCHS = 6
ALPHA, BETA, L1, L2 = 3.0, 1.0, 4.0, 1.0

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: (distance to the second word, salt) of the word pairs: the bigram and two skip-grams.
_PAIRS = ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25), (3, 0xD6E8FEB86659FD93))


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, past-last row, and row and bucket of every word, bigram and skip-gram (gaps of one and two words)."""
    for first, last, data, offsets in utf8_parts(pc.utf8_lower(column)):
        starts, ends, rows = word_spans(data, offsets, _WORD)
        words = span_hashes(data, starts, ends)
        all_rows, hashes = [rows], [words]
        for step, salt in _PAIRS:
            same = np.flatnonzero(rows[:-step] == rows[step:]) if len(rows) > step else np.zeros(0, np.int64)
            all_rows.append(rows[same])
            hashes.append(mix(words[same] * np.uint64(3) + (words[same + step] ^ np.uint64(salt))))
        yield first, last, np.concatenate(all_rows), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(samples: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets and weights of the model's non-zero coordinates, and its bias.

    A sample is the set of its buckets. Every coordinate has its own learning rate, from the sum of its squared
    gradients, and L1 keeps a weight at zero until its gradients outweigh it; the bias has no L1.
    """
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    bias = np.array([size])

    def weights(at: np.ndarray) -> np.ndarray:
        pull = np.where(at == size, 0.0, L1)
        slack = np.abs(z[at]) - pull
        return np.where(slack > 0, -np.sign(z[at]) * slack / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(samples)):
            at = np.concatenate([samples[k], bias])
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    used = np.flatnonzero(w[:size])
    return used, w[used], float(w[size])


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits the model on at most `max_docs` documents with a label (doc_id, toxic), those with the smallest id hashes, and of
    them on as many as have MAX_TRAIN_FEATURES coordinates together.

    Repeated label rows count as toxic if one is; of documents that repeat an id, the greatest text counts. Rows without
    id or label are left out; with no labelled document at all, every score is 0.5.
    """
    ship(docs.sparkSession)
    ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, marks, room = [], [], MAX_TRAIN_FEATURES
        for batch in batches:
            toxic = batch.column(2).to_pylist()
            for first, last, rows, buckets in features(batch.column(1)):
                if room <= 0:
                    continue
                pairs = sorted_unique((rows << BITS) | buckets)
                bounds = np.searchsorted(pairs >> BITS, np.arange(last - first + 1))
                fit_in = max(1, int(np.searchsorted(bounds, room, "right")) - 1)  # whole documents; one longer than all room counts alone
                room = 0 if fit_in < last - first else room - int(bounds[-1])
                packed = (pairs[: bounds[fit_in]] & ((1 << BITS) - 1)).astype(np.int32)
                samples += [packed[a:b] for a, b in zip(bounds[:fit_in], bounds[1 : fit_in + 1], strict=True)]
                marks += toxic[first : first + fit_in]
        if samples:
            used, w, bias = fit(samples, np.array(marks))
            samples.clear()
            yield pa.RecordBatch.from_pydict({"used": [used.astype(np.int32).tobytes()], "w": [w.tobytes()], "bias": [bias]})
        give_back()

    # One task holds the sample, in the order of the id hashes: the same model for any dealing of the rows.
    sample = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    got = sample.mapInArrow(run, "used binary, w binary, bias double").collect()
    if not got:
        return np.zeros(0, np.int32), np.zeros(0), 0.0
    return np.frombuffer(got[0].used, np.int32), np.frombuffer(got[0].w), got[0].bias


_dense: dict[str, np.ndarray] = {}


def _weights(token: str, used: np.ndarray, w: np.ndarray) -> np.ndarray:
    """This worker's table of a model's weights; it keeps one model's at a time."""
    if token not in _dense:
        _dense.clear()
        _dense[token] = np.zeros(1 << BITS)
        _dense[token][used] = w
    return _dense[token]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Adds each whole text's probability of being toxic as `name`; a column that has this name gives way.

    A null or empty text has the score of the bias alone; equal texts have equal scores; an empty table gives no rows.
    """
    shared, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def compute(column: pa.Array) -> list[pa.Array]:
        used, w, bias = shared.value
        dense = _weights(token, used, w)
        total = np.full(len(column), bias)
        for first, last, rows, buckets in features(column):
            live = dense[buckets] != 0
            pairs = sorted_unique((rows[live] << BITS) | buckets[live])
            total[first:last] += np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], last - first)
        return [pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))), pa.float64())]

    return map_text(docs, "text", f"`{name}` double", compute, keep)


def is_held_out(doc_id: str) -> Column:
    """True where crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~is_held_out("doc_id"))
    return train(docs, labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity: doc_id, held_out, score, predicted. A null doc_id counts as not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, fitted(spark, docs, sf_dir), ["doc_id"])
    return scored.select("doc_id", F.coalesce(is_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
