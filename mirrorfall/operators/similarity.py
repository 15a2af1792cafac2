"""Near-duplicate fingerprints: exact Hamming joins, components, cohesion, representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import average_hamming, hamming
from .tables import kept


def hamming_pairs(rows: DataFrame, tau: int, key: str = "id", fingerprint: str = "fp") -> DataFrame:
    """Pairs a < b whose 64-bit fingerprints differ in at most `tau` bits, with their distance; exact.

    Of tau + 1 bands of the bits at least one is equal in such a pair, so rows meet on (band, its bits) only. For large tau
    bands become narrow: past 12 the bands hold five bits and less, and the join approaches all pairs. Every pair is told,
    so rows with one fingerprint give the square of their number; hamming_links gives what components need in proportion.
    """
    if not 0 <= tau < 64:
        raise ValueError("tau must be within 0 and 63")
    cuts = [64 * i // (tau + 1) for i in range(tau + 2)]
    fp = F.col(fingerprint)
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)).alias("bits")) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
    keyed = rows.select(F.col(key).alias("k"), fp.alias("f"), F.explode(bands).alias("x")).select("k", "f", "x.band", "x.bits")
    a, b = keyed.alias("a"), keyed.alias("b")
    close = hamming(F.col("a.f"), F.col("b.f"))
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.k") < F.col("b.k")) & (close <= tau)
    return a.join(b, same).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), close.cast("bigint").alias("distance")).distinct()


def hamming_links(rows: DataFrame, tau: int, key: str = "id", fingerprint: str = "fp") -> DataFrame:
    """Links (a, b) with the components of hamming_pairs: equal fingerprints are collapsed to their least key, to which each
    of their rows is linked, and only distinct fingerprints are joined."""
    firsts = rows.where(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("fp")).agg(F.min(key).alias("id"))
    stars = rows.join(firsts.withColumnsRenamed({"fp": "__fp", "id": "__id"}), F.col(fingerprint) == F.col("__fp")).where(F.col(key) != F.col("__id"))
    return stars.select(F.col("__id").alias("a"), F.col(key).alias("b")).unionByName(hamming_pairs(firsts, tau).select("a", "b"))


def _flip_bands(chunk: Column, t: int) -> list[tuple[Column, list[int]]]:
    """t // 2 + 1 bands of 32 bits, each with its bits' numbers: of values that differ in at most t bits, some band differs in
    one bit at most, and for t = 0 in none. Bands take every so-manieth bit, so unused high bits are dealt over all of them."""
    m = t // 2 + 1
    bits = [list(range(k, 32, m)) for k in range(m)]
    return [(chunk.bitwiseAND(F.lit(sum(1 << j for j in held))), held if t else []) for held in bits]


def array_hamming_keys(rows: DataFrame, tau: int, key: str = "id", fingerprint: str = "fp") -> tuple[DataFrame, DataFrame]:
    """Two tables (k, f, n, low0, low4, at, band, bits): the arrays of every pair within `tau` meet on (at, band, bits) of one and the
    other. n is the array's length, low0 and low4 hold the low 16 bits of its first eight chunks.

    Over n chunks a pair differs in at most tau * n bits, so either the first chunk, which every array has, differs in tau
    bits at most, or a later one in tau - 1: else the sum were n * tau + 1 and more. The first table holds each band of these
    chunks as it is, the second also with each of its bits turned, where a bit may differ.
    """
    rows = rows.where(F.size(fingerprint) > 0).select(F.col(key).alias("k"), F.col(fingerprint).alias("f"))
    low = lambda i: F.when(F.size("f") > i, F.shiftleft(F.get("f", F.lit(i)).cast("bigint").bitwiseAND(F.lit(0xFFFF)), 16 * (i % 4))).otherwise(F.lit(0))
    packed = [low(j).bitwiseOR(low(j + 1)).bitwiseOR(low(j + 2)).bitwiseOR(low(j + 3)).alias(f"low{j}") for j in (0, 4)]
    carried = ["k", "f", "n", "low0", "low4"]
    chunks = rows.select("k", "f", F.size("f").alias("n"), *packed, F.posexplode("f").alias("at", "chunk")).withColumn("chunk", F.col("chunk").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))

    def table(turned: bool) -> DataFrame:
        def entries(t: int) -> Column:
            found = []
            for band, (value, bits) in enumerate(_flip_bands(F.col("chunk"), t)):
                values = [value, *[value.bitwiseXOR(F.lit(1 << j)) for j in bits if turned]]
                found += [F.struct(F.lit(band).alias("band"), v.alias("bits")) for v in values]
            return F.array(*found)

        later = chunks.where("at > 0").select(*carried, "at", F.inline(entries(tau - 1))) if tau else None
        first = chunks.where("at = 0").select(*carried, "at", F.inline(entries(tau)))
        return first if later is None else first.unionByName(later)

    return table(False), table(True)


def array_hamming_pairs(rows: DataFrame, tau: int, key: str = "id", fingerprint: str = "fp") -> DataFrame:
    """Pairs a < b of integer arrays whose mean chunk distance is at most `tau`; exact.

    Pairs meet as array_hamming_keys says; where arrays of one length meet, the distance of their low bits must already be
    within the bound, and the whole distance decides. Arrays with one common chunk all meet, in the square of their number.
    """
    one, other = array_hamming_keys(rows, tau, key, fingerprint)
    a, b = one.alias("a"), other.alias("b")
    bits = sum((F.bit_count(F.col(f"a.low{j}").bitwiseXOR(F.col(f"b.low{j}"))) for j in (0, 4)), F.lit(0))
    within = (F.col("a.n") != F.col("b.n")) | (bits <= tau * F.col("a.n"))
    same = (F.col("a.at") == F.col("b.at")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.k") < F.col("b.k")) & within
    met = a.join(b, same).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), average_hamming(F.col("a.f"), F.col("b.f")).alias("distance"))
    return met.where(F.col("distance") <= tau).distinct()


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component): every id of `links` (a, b) with the least id it reaches.

    Each round an id takes the least label around it and then that label's own label, so chains halve; a round is a
    written table, which cuts lineage and survives lost executors. Minima use partial aggregation.
    """
    both = kept(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("id"), "label"))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        jumped = labels.join(near, labels.id == near.a).select("id", F.least("label", "near").alias("label"))
        onward = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        after = kept(jumped.join(onward, "label", "left").select("id", F.least("label", F.coalesce("next", "label")).alias("label")))
        moved = after.join(labels.withColumnRenamed("label", "old"), "id").where("label != old")
        if moved.isEmpty():
            return after.select("id", F.col("label").alias("component"))
        labels = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def cohesive(clusters: DataFrame, rows: DataFrame, tau: int, key: str = "id", fingerprint: str = "fp") -> DataFrame:
    """component, n, diameter of the clusters whose farthest members differ in at most 2 * tau bits.

    Fingerprints of a cluster are compared once for each distinct value, not for each member.
    """
    with_fp = clusters.join(rows.select(F.col(key).alias("id"), F.col(fingerprint).alias("f")), "id")
    size = with_fp.groupBy("component").agg(F.count("*").alias("n"))
    values = with_fp.select("component", "f").distinct()
    a, b = values.alias("a"), values.alias("b")
    widest = a.join(b, (F.col("a.component") == F.col("b.component")) & (F.col("a.f") < F.col("b.f"))).groupBy(F.col("a.component").alias("component")).agg(F.max(hamming(F.col("a.f"), F.col("b.f"))).cast("bigint").alias("diameter"))
    out = size.join(widest, "component", "left").withColumn("diameter", F.coalesce("diameter", F.lit(0).cast("bigint")))
    return out.where(F.col("diameter") <= 2 * tau)


def representatives(clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """component, n_files, size (largest), fingerprint of the least path, first_path."""
    joined = clusters.join(rows, "id")
    return joined.groupBy("component").agg(F.count("*").alias("n_files"), F.max("size").alias("size"), F.min_by("fp", "path").alias("fp"), F.min("path").alias("first_path"))
