"""Substring deduplication: paragraphs by MinHash banding, verified exactly, removed by clusters; passages by winnowing.

A passage is a run of PASSAGE words and more, wherever lines break in it. Every window of PASSAGE words has an anchor, the
run of GRAM words in it with the least hash. Equal windows have equal anchors, so only windows whose anchor occurs more
than once are compared, and no repeated window is lost.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import ASCII_LOWER, NOT_BLANK, drop, give_back, materialize, mix, powers, prefix_hashes, ship, span_hashes, utf8_parts, word_spans
from .neardups import _identity, clusters, shingle_sets, signed

#: The similarity from which pairs have to be found, the share of such pairs that may be missed, and hashes in a band.
SIMILARITY, MISSED, ROWS = 0.8, 5e-6, 2


def bands_for(similarity: float, missed: float, rows: int) -> int:
    """The fewest bands of `rows` hashes with which a pair of this similarity shares none with a probability below `missed`."""
    return math.ceil(math.log(missed) / math.log(1 - similarity**rows))


BANDS = bands_for(SIMILARITY, MISSED, ROWS)
#: Paragraphs with fewer words are left alone.
MIN_WORDS = 20
#: Words of the shortest passage, and of the anchors in it.
PASSAGE, GRAM = 50, 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_WORDS_AND_BLANKS = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
_KEYED = "doc_id long, text_hash long, para_no int, n long, s1 long, s2 long, bands array<long>"


def banded(docs: DataFrame) -> DataFrame:
    """A row for each paragraph of at least MIN_WORDS words: its place, the identity of its shingle set, and its band keys."""
    ship(docs.sparkSession)
    salts = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    names = [c.split()[0] for c in _KEYED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, texts = (batch.column(i).to_pylist() for i in range(3))
            places, paragraphs, size = [], [], 0
            for k, text in enumerate(texts):
                for number, line in enumerate((text or "").split("\n")):
                    if len(line) >= 2 * MIN_WORDS - 1:
                        places.append((ids[k], marks[k], number))
                        paragraphs.append(line)
                        size += len(line)
                if paragraphs and (size > 2 << 20 or k == len(texts) - 1):
                    yield _bands(places, paragraphs, salts, names)
                    places, paragraphs, size = [], [], 0
            if paragraphs:
                yield _bands(places, paragraphs, salts, names)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, _KEYED)


def _bands(places: list[tuple], paragraphs: list[str], salts: np.ndarray, names: list[str]) -> pa.RecordBatch:
    out: list[list] = [[] for _ in names]
    for first, last, bounds, hashes in shingle_sets(pa.array(paragraphs, pa.string())):
        n = np.diff(bounds)
        one, two = (_identity(bounds, hashes, salt) for salt in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))
        least = np.zeros((len(salts), last - first), np.uint64)
        filled = np.flatnonzero(n)
        if len(filled):
            for k, salt in enumerate(salts):
                least[k, filled] = np.minimum.reduceat((hashes ^ (salt >> np.uint64(7))) * salt, bounds[:-1][filled])
        keys = np.zeros((BANDS, last - first), np.uint64)
        for b in range(BANDS):
            acc = np.full(last - first, b + 1, np.uint64)
            for row in least[b * ROWS : (b + 1) * ROWS]:
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + row)
            keys[b] = acc
        for k in range(first, last):
            # The words, not the distinct shingles, decide whether a paragraph is long enough.
            if n[k - first] and (n[k - first] + 4 >= MIN_WORDS or len(paragraphs[k].split()) >= MIN_WORDS):
                for column, value in zip(out, (*places[k], int(n[k - first]), int(one[k - first]), int(two[k - first]), keys[:, k - first].view(np.int64)), strict=True):
                    column.append(value)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)


def clustered_paragraphs(docs: DataFrame) -> DataFrame:
    """Every paragraph that others match: doc_id, text_hash, para_no, cluster (the least place in it), removed.

    A paragraph is a line of at least MIN_WORDS words. Two match at a Jaccard similarity of 0.8 or more of their sets of
    five-word shingles; candidates share a MinHash band and are verified on the whole sets. A cluster is a component of
    matches. Its first place, in the order of doc_id, text hash and number, stays and the others are removed. Rows that
    repeat an id and text have equal places, of which none removes the other. A null or empty text has no paragraphs.
    """
    full = materialize(banded(docs), "paragraphs")
    rows = materialize(full.drop("n", "bands"), "paragraph-names")
    place = F.struct("doc_id", "text_hash", "para_no")
    found = full.groupBy("s1", "s2").agg(F.min(F.struct(place.alias("own"), "n", "bands")).alias("x"), F.count("*").alias("copies"))
    sets = materialize(found.select(F.monotonically_increasing_id().alias("id"), "s1", "s2", "copies", "x.*"), "paragraph-sets")
    drop(full)
    keys = sets.select("id", "n", F.explode("bands").alias("key"))
    heads = materialize(keys.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("h1"), F.sum(F.xxhash64(F.lit(3), "id").cast("decimal(20,0)")).alias("h2")).where("c > 1"), "band-heads")
    # Of bands with the same sets one stays.
    kept = materialize(heads.groupBy("c", "h1", "h2").agg(F.min("key").alias("key")).select("key", "c"), "bands")
    drop(heads)
    buckets = materialize(keys.join(kept, "key").select("key", "id", "n", "c"), "band-rows")
    named = materialize(sets.select("id", "s1", "s2", "copies", "own"), "named-paragraphs")
    wanted = materialize(buckets.select("id").distinct().join(sets.select("id", "n", "own"), "id").select("id", "n", "own.*"), "wanted-paragraphs")
    drop(kept, sets)
    lines = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("para_no", "text")).where(F.length("text") >= 2 * MIN_WORDS - 1)
    w = wanted.withColumnsRenamed({"doc_id": "w_id", "text_hash": "w_hash", "para_no": "w_no"})
    found = lines.join(w, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")) & (F.col("para_no") == F.col("w_no")))
    texts = materialize(signed(found.select("id", "n", "text"), ["id", "n", "text"]).drop("s1", "s2").dropDuplicates(["id"]), "paragraph-texts")
    drop(wanted)
    parts = clusters(buckets, texts)
    by_set = materialize(named.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")), "paragraph-components")
    drop(named, parts)
    firsts = by_set.groupBy("component").agg(F.min("own").alias("cluster"), F.count("*").alias("sets"))
    verdicts = materialize(by_set.join(firsts, "component").where("sets > 1 or copies > 1").select("s1", "s2", "cluster"), "paragraph-verdicts")
    drop(by_set)
    return rows.join(verdicts, ["s1", "s2"]).select("doc_id", "text_hash", "para_no", "cluster", (F.struct("doc_id", "text_hash", "para_no") != F.col("cluster")).alias("removed"))


def _windows(column: pa.Array) -> Iterator[tuple]:
    """First row, past-last row, and of the words the rows, line numbers and numbers in the text; of every window of PASSAGE
    words its first word, its hash, and the word at which its anchor begins; and the hash of the GRAM words from each word."""
    for first, last, data, offsets in utf8_parts(column):
        starts, ends, rows = word_spans(data, offsets, NOT_BLANK)
        breaks = np.append(0, np.cumsum(data == 10))
        lines = breaks[starts] - breaks[offsets[rows]]
        n = len(starts)
        begin = np.searchsorted(rows, np.arange(last - first))
        number = np.arange(n) - begin[rows]
        if n < PASSAGE:
            none = np.zeros(0, np.int64)
            yield first, last, rows, lines, number, none, none.astype(np.uint64), none, none.astype(np.uint64)
            continue
        sums = prefix_hashes(span_hashes(ASCII_LOWER[data], starts, ends))
        _, down = powers(n + 1)
        run = lambda size: mix((sums[size:] - sums[:-size]) * down[: n - size + 1])  # noqa: B023, E731
        grams, windows = run(GRAM), run(PASSAGE)
        at = np.flatnonzero(rows[: n - PASSAGE + 1] == rows[PASSAGE - 1 :])
        wide = np.lib.stride_tricks.sliding_window_view(grams, PASSAGE - GRAM + 1)
        anchors = np.concatenate([at[k : k + 65536] + wide[at[k : k + 65536]].argmin(axis=1) for k in range(0, len(at), 65536)] or [at])
        yield first, last, rows, lines, number, at, windows[at], anchors, grams


def _anchors(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, anchor, twice) of each text's anchors, and one with a null anchor, the number of words and
    the line of the first for each text of at least PASSAGE words."""
    ship(docs.sparkSession)
    schema = "doc_id long, text_hash long, anchor long, twice boolean, words int, line int"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, rows, lines, _, _, _, anchors, grams in _windows(batch.column(2)):
                places = np.unique(anchors)
                order = np.lexsort((grams[places], rows[places]))
                row, gram = rows[places][order], grams[places][order]
                head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]))) if len(row) else np.zeros(0, np.int64)
                count = np.diff(np.append(head, len(row)))
                words = np.bincount(rows, minlength=last - first)
                whole = np.flatnonzero(words >= PASSAGE)
                begin = np.searchsorted(rows, whole)
                take = pa.array(first + np.concatenate([row[head], whole]))
                a, b = len(head), len(whole)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), batch.column(1).take(take),
                        pa.concat_arrays([pa.array(gram[head].view(np.int64)), pa.nulls(b, pa.int64())]),
                        pa.array(np.append(count > 1, np.zeros(b, bool))),
                        pa.concat_arrays([pa.nulls(a, pa.int32()), pa.array(words[whole], pa.int32())]),
                        pa.concat_arrays([pa.nulls(a, pa.int32()), pa.array(lines[begin], pa.int32())]),
                    ],
                    names=names,
                )
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(run, schema)


def _open_windows(texts: DataFrame) -> DataFrame:
    """The windows of texts (doc_id, text_hash, anchors, text) whose anchor is one of the text's `anchors`."""
    ship(texts.sparkSession)
    schema = "w long, doc_id long, text_hash long, start int, line int"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2)
            for first, last, rows, lines, number, at, windows, anchors, grams in _windows(batch.column(3)):
                part = wanted.slice(first, last - first)
                owners = np.repeat(np.arange(last - first), np.array([len(x) for x in part]))
                marks = mix(part.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ mix(owners.astype(np.uint64) + np.uint64(1)))
                mine = np.isin(mix(grams[anchors] ^ mix(rows[anchors].astype(np.uint64) + np.uint64(1))), marks)
                at, windows = at[mine], windows[mine]
                take = pa.array(first + rows[at])
                for k in range(0, len(at), 65536):
                    some = slice(k, k + 65536)
                    yield pa.RecordBatch.from_arrays([pa.array(windows[some].view(np.int64)), batch.column(0).take(take[some]), batch.column(1).take(take[some]), pa.array(number[at[some]], pa.int32()), pa.array(lines[at[some]], pa.int32())], names=names)

    return texts.select("doc_id", "text_hash", "anchors", "text").mapInArrow(run, schema)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Every passage that occurs before: doc_id, text_hash, para_no and first_word (where it begins), n_words, and `first`,
    the place (doc_id, text_hash, first_word, para_no) of its first occurrence.

    Words are compared with A to Z in lower case. Of equal windows of PASSAGE words the first stays, in the order of doc_id,
    text hash and word; the others are repeats, but for those that overlap the first in its own text. Repeats that go on
    side by side with their first occurrences are one passage. Of rows with equal texts, those behind the first id are
    repeats as a whole. Word numbers count from 0 over the whole text.
    """
    rows = materialize(_anchors(docs), "anchors")
    whole = rows.where("anchor is null").select("doc_id", "text_hash", "words", "line")
    owners = materialize(whole.groupBy("text_hash").agg(F.min(F.struct("doc_id", "words", "line")).alias("o")).select("text_hash", F.col("o.doc_id").alias("owner"), "o.words", "o.line"), "passage-owners")
    named = rows.where("anchor is not null").select("anchor", "text_hash", "twice")
    # Copies of a text don't make its anchors repeated.
    repeated = named.groupBy("anchor").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b"), F.max("twice").alias("twice")).where("a != b or twice").select("anchor")
    repeated = materialize(repeated, "repeated-anchors")
    open_ = named.join(repeated, "anchor").groupBy("text_hash").agg(F.collect_set("anchor").alias("anchors"))
    wanted = materialize(open_.join(owners, "text_hash").select("text_hash", "owner", "anchors"), "open-texts")
    whole = materialize(whole, "whole-texts")
    drop(rows, repeated)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").join(wanted, "text_hash").where(F.col("doc_id").eqNullSafe(F.col("owner")))
    windows = materialize(_open_windows(texts), "windows")
    place = F.struct("doc_id", "text_hash", F.col("start").alias("first_word"), F.col("line").alias("para_no"))
    firsts = windows.groupBy("w").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("w", "first")
    firsts = materialize(firsts, "first-windows")
    later = windows.join(firsts, "w").where((F.col("text_hash") != F.col("first.text_hash")) | (F.col("start") - F.col("first.first_word") >= PASSAGE))
    side = later.select("doc_id", "text_hash", "start", "line", "first", (F.col("start") - F.col("first.first_word")).alias("shift")).dropDuplicates(["text_hash", "start"])
    run = Window.partitionBy("text_hash", "first.text_hash", "shift").orderBy("start")
    islands = side.withColumn("island", F.col("start") - F.row_number().over(run))
    found = islands.groupBy("text_hash", F.col("first.text_hash").alias("of"), "shift", "island").agg(F.min(F.struct("start", "doc_id", "line", "first")).alias("x"), F.max("start").alias("end"))
    parts = found.select("x.doc_id", "text_hash", F.col("x.line").alias("para_no"), F.col("x.start").alias("first_word"), (F.col("end") - F.col("x.start") + PASSAGE).alias("n_words"), "x.first")
    parts = materialize(parts, "passages")
    drop(wanted, windows, firsts)
    copies = whole.select("doc_id", "text_hash").distinct().join(owners, "text_hash").where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    zero = F.lit(0).cast("int")
    origin = F.struct(F.col("owner").alias("doc_id"), "text_hash", zero.alias("first_word"), F.col("line").alias("para_no"))
    return parts.unionByName(copies.select("doc_id", "text_hash", F.col("line").alias("para_no"), zero.alias("first_word"), F.col("words").alias("n_words"), origin.alias("first")))


def _cut(text: str | None, lines: list[int] | None, spans: list | None) -> str | None:
    """The text without the words of `spans` (first word, number of words), and without the lines that are in `lines` or left without a word."""
    if text is None or not (lines or spans):
        return text
    gone = {k for first, n in spans or () for k in range(first, first + n)}
    drop, out, at = set(lines or ()), [], 0
    for number, line in enumerate(text.split("\n")):
        words = len(_WORD.findall(line))
        if number not in drop and not (words and gone.issuperset(range(at, at + words))):
            k = at - 1

            def left(found: re.Match) -> str:
                nonlocal k
                k += 1
                return "" if k in gone else found[0]

            out.append(_WORDS_AND_BLANKS.sub(left, line) if not gone.isdisjoint(range(at, at + words)) else line)
        at += words
    return "\n".join(out)


def dedup_paragraphs(docs: DataFrame) -> DataFrame:
    """Documents without the removed paragraphs and the repeated passages; one that has no word left is dropped."""
    ship(docs.sparkSession)
    lines = clustered_paragraphs(docs).where("removed").groupBy("doc_id", "text_hash").agg(F.collect_set("para_no").alias("gone"))
    spans = repeated_passages(docs).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first_word", "n_words")).alias("spans"))
    none = lambda df, name, kind: df.withColumn(name, F.lit(None).cast(kind))
    both = none(lines, "spans", spans.schema["spans"].dataType).unionByName(none(spans, "gone", lines.schema["gone"].dataType))
    gone = materialize(both.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__of")).agg(F.first("gone", True).alias("__gone"), F.first("spans", True).alias("__spans")), "passage-removals")
    joined = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__of")), "left")
    touched = F.col("__of").isNotNull()
    cut = joined.withColumn("text", F.when(touched, F.udf(_cut, "string")("text", "__gone", "__spans")).otherwise(F.col("text")))
    cut = cut.where(~touched | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(touched, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def op1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated paragraph of `documents`: doc_id, para_no, cluster_doc_id and cluster_para_no (its cluster's first), removed;
    and every repeated passage, with the paragraphs in which it and its first occurrence begin, first_word and n_words (null
    for whole paragraphs)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = clustered_paragraphs(docs)
    no = F.lit(None).cast("int")
    whole = out.select("doc_id", "para_no", F.col("cluster.doc_id").alias("cluster_doc_id"), F.col("cluster.para_no").alias("cluster_para_no"), "removed", no.alias("first_word"), no.alias("n_words"))
    parts = repeated_passages(docs).select("doc_id", "para_no", F.col("first.doc_id").alias("cluster_doc_id"), F.col("first.para_no").alias("cluster_para_no"), F.lit(True).alias("removed"), "first_word", "n_words")
    return whole.unionByName(parts)
