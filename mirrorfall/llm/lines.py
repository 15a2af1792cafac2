"""Line deduplication as an exact set-similarity self-join, with DataFrame operations only.

1. Lines are written in the order of their places and numbered by it. Equal lines are merged by their hashes, without their
   text, to the first number. The first lines' texts and signatures are dealt out by number once; the joins that follow move
   only the numbers and, of lines that are in a pair, the texts.
2. A line's leads are hashes of one of its two least and one of its two greatest word hashes each, so near copies share most of
   them. Each line is held against the first lines of each of its leads; a match bounds what is still sought for it. Of a
   group of near copies, all but a few are bound to the first, and do not meet each other.
3. A line's distinct words are ordered by rarity. Two lines match only if their prefixes share a word; of pairs that do, those
   stay whose earlier line comes before the later one's bound, whose lengths allow a match, whose words behind the shared one
   still suffice, and whose parity sketches (128 bits, each word flips one) differ in no more bits than the sets may differ in
   words. Words stand here as hashes, which can only add pairs. The words are searched in parts, so that the prefixes of only
   one part are on disk at a time.
4. Pairs are decided on the words themselves, and each line takes its earliest match.

Arrays are exploded as outer ones: before others Spark puts a filter on the array's size, which computes the array again.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import collect_garbage, drop, fresh, materialize, materialize_by

#: Lines match where 100 * |A and B| >= PERCENT * |A or B| over their sets of words.
PERCENT = 80
#: Hash buckets in which words are counted for their order of rarity; tasks get one byte for each.
BUCKETS = 1 << 16
_BLANKS = r"[\x20\x09-\x0D]+"
_BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Bits of a word's hash below its level.
_HASH_BITS = 55
#: Against how many of a lead's first lines its others are held; the very first can be an outlier of its group.
_HEADS = 4
#: Parts in which prefix words are searched one after another, all of them.
_PARTS = 2


def _words(line: Column) -> Column:
    """The words of a line; most lines have no blank but spaces, on which splitting is fast."""
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c"))
    return F.array_remove(F.when(odd, F.split(line, _BLANKS)).otherwise(F.split(line, " ")), "")


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK_CHARS)) != ""


def _bucket(word_hash: Column) -> Column:
    return word_hash.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def rarity_levels(lines: DataFrame) -> bytes:
    """A byte for each hash bucket of words: the logarithm, in steps of a fifth, of how often its words occur in `lines` (line)."""
    # Cut at spaces alone, which is cheap: any order of words is right, if it is one for all lines.
    hashes = lines.select(F.explode_outer(F.split("line", " ")).alias("w")).select(_bucket(F.xxhash64("w")).alias("b"))
    counted = hashes.groupBy("b").agg(F.least(F.floor(5 * F.log1p(F.count("*"))), F.lit(127)).cast("int").alias("level"))
    every = lines.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    # At most BUCKETS rows meet here, whatever the vocabulary.
    dense = every.join(counted, "b", "left").select(F.struct("b", F.lpad(F.hex(F.coalesce("level", F.lit(0))), 2, "0").alias("level")).alias("x"))
    return bytes(dense.agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["level"]), "")).alias("levels")).first().levels)


def numbered_lines(docs: DataFrame, ids: list[str]) -> DataFrame:
    """A row for each line that has a word: the columns `ids`, line_no from 0, and line."""
    lines = docs.select(*ids, F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(_has_word(F.col("line")))


def _line_key() -> list[Column]:
    return [F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(7), F.col("line")).alias("k2")]


def place_type(docs: DataFrame, ids: list[str]) -> T.StructType:
    return T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in ids], T.StructField("line_no", T.IntegerType())])


def _need(n: Column, m: Column) -> Column:
    """The least overlap with which sets of n and m words match."""
    return F.call_function("div", PERCENT * (n + m) + F.lit(100 + PERCENT - 1), F.lit(100 + PERCENT))


def signatures(firsts: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Of each line (id, line): id, n (its distinct words), prefix, s0 and s1 (its sketch), picks (hashes of words from which
    leads are made). Words' rarity is counted over `every` (line), by default over the same lines."""
    levels = F.from_json(F.lit(json.dumps(list(rarity_levels(firsts if every is None else every)))), "array<long>")  # one constant
    low = F.lit((1 << _HASH_BITS) - 1)
    # Rarer words first; equal levels in the order of the hashes, equal hashes in any. A null would make the sort a slow one.
    code = lambda h: F.shiftleft(F.coalesce(F.get(levels, _bucket(h)), F.lit(0).cast("long")), _HASH_BITS).bitwiseOR(h.bitwiseAND(low))
    hashed = firsts.select("id", F.sort_array(F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)))).alias("hashes"))
    # Columns of their own: below a lambda's argument all is interpreted, and made again for each time that it is named.
    hashed = hashed.select("id", "hashes", F.sort_array(F.transform("hashes", code)).alias("codes"), F.size(F.filter("hashes", lambda h: h < 0)).alias("least"))
    n = F.size("codes")
    prefix = F.slice("codes", F.lit(1), n - F.call_function("div", PERCENT * n + 99, F.lit(100)).cast("int") + 1)
    flip = lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))
    # Half of the words, by the hash's sign, flip bits of s0, the others of s1.
    halves = {"s0": F.slice("hashes", F.lit(1), F.col("least")), "s1": F.slice("hashes", F.col("least") + 1, n - F.col("least"))}
    sketch = [F.aggregate(half, F.lit(0).cast("long"), flip).alias(s) for s, half in halves.items()]
    at = lambda k: F.coalesce(F.get("hashes", k), F.col("hashes")[0])
    # Made before lines fan out, so once for each line; of a word's code, 32 bits are enough to meet by.
    return hashed.select("id", n.alias("n"), F.transform(prefix, lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))).alias("prefix"), *sketch, F.array(at(F.lit(0)), at(F.lit(1)), at(n - 2), at(n - 1)).alias("picks"))


def _like(an: Column, bn: Column, a: str, b: str) -> Column:
    """Whether the lengths and sketches of a and b let them match."""
    apart = sum(F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in ("s0", "s1"))
    return (100 * F.least(an, bn) >= PERCENT * F.greatest(an, bn)) & (apart <= an + bn - 2 * _need(an, bn))


def _heads(signed: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids: a is one of the first _HEADS lines of one of b's leads, and earlier. `signed` has id, n, s0, s1, picks."""
    leads = [F.xxhash64(F.lit(2 * i + j), F.col("picks")[i], F.col("picks")[2 + j]) for i in range(2) for j in range(2)]
    led = signed.select(F.struct("id", "n", "s0", "s1").alias("own"), F.explode_outer(F.array(*leads)).alias("lead"))
    first = lambda k: F.nth_value("own", k).over(Window.partitionBy("lead").orderBy("own.id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    others = led.select("own", *[first(k + 1).alias(f"h{k}") for k in range(_HEADS)]).where("h1 is not null")
    met = others.select("own", F.explode_outer(F.array(*[f"h{k}" for k in range(_HEADS)])).alias("head")).where("head.id < own.id")
    met = met.where(_like(F.col("head.n"), F.col("own.n"), "head", "own"))
    return met.select(F.col("head.id").alias("a"), F.col("own.id").alias("b")).distinct()


def _candidates(signed: DataFrame, part: int | None = None) -> DataFrame:
    """Pairs (a, b) of ids of `signed` (id, bound, n, prefix, s0, s1) that pass all filters, a before b's bound or, where it is
    null, b; given a part, those that share a word of this one of the _PARTS."""
    keys = signed.select(F.posexplode_outer("prefix").alias("pos", "word"), "id", "bound", "n", "s0", "s1")
    if part is not None:
        keys = keys.where(F.col("word") % _PARTS == part)
    keys = keys.select("word", "id", F.coalesce("bound", "id").alias("until"), F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("n").cast("long")).alias("pn"), "s0", "s1")
    a, b = keys.alias("a"), keys.alias("b")
    n_of = lambda x: F.col(f"{x}.pn").bitwiseAND(F.lit(0xFFFFFFFF))
    pos_of = lambda x: F.shiftright(f"{x}.pn", 32)
    an, bn, ap, bp = n_of("a"), n_of("b"), pos_of("a"), pos_of("b")
    need = _need(an, bn)
    # The second term follows from the first; it has both sides read the same columns, so that one shuffle serves both.
    close = (F.col("a.id") < F.col("b.until")) & (F.col("a.until") < F.col("b.id")) & _like(an, bn, "a", "b") & (F.least(an - ap, bn - bp) >= need)
    return a.join(b, (F.col("a.word") == F.col("b.word")) & close).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def candidates(firsts: DataFrame) -> DataFrame:
    """Pairs (a, b) of numbers of `firsts` (id, line) that pass all filters, a < b."""
    return _candidates(signatures(firsts).withColumn("bound", F.lit(None).cast("long")))


def _verified(pairs: DataFrame, ranks: DataFrame | None, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines match and have different places, with b's id and a's place as `early`. `lines` has id, own
    and line; a and b are its ids or, given `ranks` (id, rank), their ranks."""
    sides = pairs.select("a", "b", F.explode_outer(F.array("a", "b")).alias("id"))
    if ranks is not None:
        sides = sides.withColumnRenamed("id", "rank").join(ranks, "rank").drop("rank").withColumnRenamed("id", "id_")
        sides = sides.select("a", "b", F.col("id_").alias("id"))
    # All lines pass by once, in place if they are dealt out by id, and those in no pair go; a pair's two lines meet after.
    paired = lines.select("id", "own", "line").join(sides.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")
    side = sides.join(paired, "id").select("a", "b", F.struct("own", "id", "line").alias("side"))
    met = side.groupBy("a", "b").agg(F.min("side").alias("x"), F.max("side").alias("y")).where("x.own != y.own")
    # A lambda's argument is computed once, a column of a filter as often as it is named.
    given = lambda x, f: F.transform(F.array(x), f)[0]
    words = F.struct(*[F.array_distinct(_words(F.col(f"{x}.line"))).alias(x) for x in "xy"])
    counted = given(words, lambda w: F.struct(F.size(F.array_intersect(w["x"], w["y"])).alias("both"), (F.size(w["x"]) + F.size(w["y"])).alias("sum")))
    return met.where(given(counted, lambda c: 100 * c["both"] >= PERCENT * (c["sum"] - c["both"]))).select("a", "b", F.col("y.id").alias("id"), F.col("x.own").alias("early"))


def ordered_lines(docs: DataFrame, ids: list[str]) -> DataFrame:
    """Every line that has a word: id, own (its place) and line; ids are in the order of places. Rows that share all of `ids`
    are ordered in one task."""
    lines = numbered_lines(docs.select(*ids, "text").repartitionByRange(*ids), ids).sortWithinPartitions(*ids, "line_no")
    return lines.select(F.monotonically_increasing_id().alias("id"), F.struct(*ids, "line_no").cast(place_type(docs, ids)).alias("own"), "line")


def matching_lines(docs: DataFrame, ids: list[str]) -> DataFrame:
    """Every distinct line that is repeated or has an earlier match: k1, k2 (its key) and first, the least place of the line
    and its matches.

    A place is the struct of `ids` and line_no; nulls in it come first. Words are compared as written. Several lines can
    have one place, where rows share all of `ids`; of these none is earlier than another.
    """
    lines = materialize(ordered_lines(docs, ids), "ordered-lines")
    collect_garbage(docs.sparkSession)
    # Copies meet here after each task has merged its own.
    merged = lines.select(*_line_key(), "id").groupBy("k1", "k2").agg(F.min("id").alias("id"), (F.count("*") > 1).alias("repeated"))
    firsts = materialize(merged.select("id", "repeated"), "first-lines")
    texts = materialize_by(lines.join(firsts.hint("shuffle_hash"), "id"), "line-texts", "id")
    drop(lines, firsts)
    collect_garbage(docs.sparkSession)
    signed = materialize_by(signatures(texts.select("id", "line")), "line-signatures", "id")
    collect_garbage(docs.sparkSession)
    heads = materialize(_heads(signed), "line-heads")
    collect_garbage(docs.sparkSession)
    bounds = materialize(_verified(heads, None, texts).groupBy("b", "id").agg(F.min("a").alias("bound"), F.min("early").alias("early")), "line-bounds")
    drop(heads)
    collect_garbage(docs.sparkSession)
    bounded = materialize(signed.drop("picks").join(bounds.select("id", "bound").hint("shuffle_hash"), "id", "left"), "line-bounded")
    drop(signed)
    parts = []
    for part in range(_PARTS):
        collect_garbage(docs.sparkSession)
        parts.append(materialize(_candidates(bounded, part), "line-pairs"))
    drop(bounded)
    collect_garbage(docs.sparkSession)
    found = _verified(reduce(DataFrame.union, parts).distinct(), None, texts).select("id", "early").union(bounds.select("id", "early"))
    matched = materialize(found.groupBy("id").agg(F.min("early").alias("early")), "line-matches")
    drop(*parts, bounds)
    out = texts.join(matched.hint("shuffle_hash"), "id", "left").where("repeated or early is not null")
    out = materialize(out.select(*_line_key(), F.least("own", "early").alias("first")), "line-verdicts")
    drop(texts, matched)
    return out


def judged_lines(docs: DataFrame, ids: list[str]) -> DataFrame:
    """A row for each line with a word: `ids`, line_no, line_key, `first` (the place of its earliest match, else null), `removed`.

    A line is removed if it matches any earlier one, whether or not that one is kept. Rows that share all of `ids` have
    equal places and do not remove each other's equal lines. A null or empty text has no such line.
    """
    found = matching_lines(docs, ids)
    lines = numbered_lines(docs, ids).select(F.struct(*ids, "line_no").alias("place"), *_line_key())
    out = lines.join(found, ["k1", "k2"], "left").select("place.*", F.col("k1").alias("line_key"), F.when(F.col("first") < F.col("place"), F.col("first")).alias("first"))
    return out.withColumn("removed", F.col("first").isNotNull())


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Documents without the lines that match an earlier one; a document all of whose lines with words go is dropped.

    The order of lines is that of doc_id and line number; a null id comes first. All columns stay; n_chars, where there is
    one, is the new text's length. Rows without a word stay as they are. Rows that repeat a doc_id are compared with other
    documents, not with each other. An empty table gives no rows; a text of any length is split within one row.
    """
    keyed = docs.select("doc_id", "text")
    gone = judged_lines(keyed, ["doc_id"]).where("removed").groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "line_key")).alias("gone"))
    gone = materialize(gone, "line-removals")
    gone_id, left = fresh("__gone_id", docs.columns), fresh("__left", docs.columns)
    gone_at = fresh("__gone", docs.columns)
    gone = gone.select(F.col("doc_id").alias(gone_id), F.col("gone").alias(gone_at))
    stays = lambda x, i: ~F.array_contains(gone_at, F.struct(i.alias("line_no"), F.xxhash64(x).alias("line_key")))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone[gone_id]), "left").withColumn(left, F.filter(F.split("text", "\n"), stays))
    cut = joined.where(F.col(gone_at).isNull() | F.exists(left, _has_word))
    cut = cut.withColumn("text", F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(gone_at).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return cut.select(*docs.columns)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of `documents` that has a word: doc_id, line_no, removed, first_doc_id and first_line_no of its earliest
    match (null where it has none). A null or empty text has no line; a null id comes first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = judged_lines(docs, ["doc_id"])
    return out.select("doc_id", "line_no", "removed", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"))
