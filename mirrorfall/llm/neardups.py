"""Near-duplicate documents: an exact Jaccard join on word shingles through signature trees.

1. Every text becomes a set of 64-bit hashes of its distinct shingles. Texts with equal sets are collapsed to one.
2. Sets are dealt into buckets by the shingles of their prefixes: of two sets with a Jaccard similarity of at least 80
   percent, the first n - ceil(0.8 n) + 1 shingles, in any order common to all, share one. Shingles that many texts share
   come last in that order, so passages that documents quote don't fill buckets. Of buckets with the same sets one stays.
3. A set's signature is a bitmap of its shingles, of about eight bits for each. A node of a signature tree holds the OR of
   its sets' bitmaps (folded to two bits a shingle) and the range of their sizes, and two nodes are parted where the overlap
   that they could have at most is less than the least that a match needs. The first level is one set of each bucket, that of
   most ties, against the others: it connects groups of near copies at the cost of one comparison a set, and leaves most
   buckets in one component.
4. The other buckets' sets go to a tree for each bucket, traversed against itself for pairs of different components. Large
   buckets are cut into blocks by size; pairs of blocks whose ranges of sizes allow a match are dealt to tasks, about
   N * N / BLOCK rows for N sets of like size, and tested as nodes there. A first traversal tells of each bucket only pairs
   that would connect its components (a spanning forest, likeliest pairs first), a number in proportion to its sets. What
   they leave apart is told in full by a second one; these are pairs that miss a match by a shingle or two.
5. Surviving pairs are verified on the whole sets, and components take the least document id over all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import ASCII_LOWER, NOT_BLANK, drop, give_back, map_text, materialize, mix, ship, span_hashes, utf8_parts, word_spans

WORDS = 5
PERCENT = 80
#: Sets of a block in a bucket, and of a leaf in a tree; children of an inner node.
BLOCK, LEAF, FAN = 1024, 16, 4
#: Bits of the smallest bitmap, bits for each shingle, and how many bitmaps of inner nodes fit into a set's.
LEAST_BITS, SHINGLE_BITS, NARROWER = 512, 8, 4
#: Pairs of one hub that are verified in a task.
HUB_PAIRS = 1024
#: A shingle is common where tasks have seen it in more than this many texts; at most COMMON_SHINGLES of them, the most
#: frequent, come last in the prefix order. Both only move work: any order gives the same links.
COMMON_TEXTS, COMMON_SHINGLES = 24, 1 << 20
_TASK_SHINGLES = 4 << 20


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, past-last row, bounds and hashes of each text's distinct shingles, sorted within a text.

    Words are runs of other than ASCII white space, A to Z in lower case. A text of fewer than WORDS words has its whole
    sequence as one shingle, and none without words.
    """
    for first, last, data, offsets in utf8_parts(column):
        starts, ends, rows = word_spans(data, offsets, NOT_BLANK)
        words = span_hashes(ASCII_LOWER[data], starts, ends)
        counts = np.bincount(rows, minlength=last - first)
        long_rows = counts >= WORDS
        n = len(words)
        acc = np.zeros(n, np.uint64)
        for k in range(WORDS if n >= WORDS else 0):
            acc[: n - k] = acc[: n - k] * np.uint64(0x9E3779B97F4A7C15) + words[k:]
        begin = np.cumsum(counts) - counts
        place = np.arange(n) - begin[rows]
        full = long_rows[rows] & (place <= counts[rows] - WORDS)
        all_rows, hashes = [rows[full]], [mix(acc[full])]
        for row in np.flatnonzero(~long_rows & (counts > 0)):
            total = np.uint64(counts[row])
            with np.errstate(over="ignore"):
                for w in words[begin[row] : begin[row] + counts[row]]:
                    total = total * np.uint64(0xC2B2AE3D27D4EB4F) + w
            all_rows.append(np.array([row]))
            hashes.append(mix(np.array([total], np.uint64)))
        all_rows, hashes = np.concatenate(all_rows), np.concatenate(hashes)
        order = np.lexsort((hashes, all_rows))
        all_rows, hashes = all_rows[order], hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (all_rows[1:] != all_rows[:-1])
        all_rows, hashes = all_rows[new], hashes[new]
        yield first, last, np.searchsorted(all_rows, np.arange(last - first + 1)), hashes


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Hashes of shingles in many texts, sorted: each task counts over a few million shingles at once and tells those that it
    met twice, so what is told of a shingle is a lower bound of its texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held))
            held.clear()
            at = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            n = np.diff(np.append(at, len(every)))
            return pa.RecordBatch.from_arrays([pa.array(every[at[n > 1]].view(np.int64)), pa.array(n[n > 1])], names=["shingle", "n"])

        for batch in batches:
            for _, _, bounds, hashes in shingle_sets(batch.column(0)):
                # Copies of a text within the run count once.
                sums = np.append(np.uint64(0), np.cumsum(mix(hashes)))
                marks = sums[bounds[1:]] - sums[bounds[:-1]]
                _, once = np.unique(marks, return_index=True)
                keep = np.zeros(len(marks), bool)
                keep[once] = True
                held.append(hashes[np.repeat(keep, np.diff(bounds))])
                if sum(map(len, held)) >= _TASK_SHINGLES:
                    yield told()
        if sum(map(len, held)):
            yield told()
        give_back()

    seen = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = seen.where(F.col("n") > COMMON_TEXTS).orderBy(F.desc("n"), "shingle").limit(COMMON_SHINGLES).select("shingle")
    return np.sort(np.array([r.shingle for r in top.toLocalIterator()], np.int64).view(np.uint64))


def keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Adds n (set size), s1 and s2 (the set's identity) and its prefix: rare and common shingles apart."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def compute(column: pa.Array) -> list[pa.Array]:
        common = shared.value
        sizes, one, two, lists = [], [], [], ([], [])
        for first, last, bounds, hashes in shingle_sets(column):
            n = np.diff(bounds)
            rows = np.repeat(np.arange(last - first), n)
            late = np.isin(hashes, common, assume_unique=False) if len(common) else np.zeros(len(hashes), bool)
            order = np.lexsort((hashes, late, rows))
            prefix = np.where(n > 0, n - (PERCENT * n + 99) // 100 + 1, 0)
            chosen = order[np.arange(len(hashes)) - bounds[rows] < prefix[rows]]
            for out, mine in zip(lists, (chosen[~late[chosen]], chosen[late[chosen]]), strict=True):
                out.append((np.bincount(rows[mine], minlength=last - first), hashes[mine]))
            sizes.append(n)
            one.append(_identity(bounds, hashes, 0x9FB21C651E98DF25))
            two.append(_identity(bounds, hashes, 0xD6E8FEB86659FD93))
        return [pa.array(np.concatenate(sizes)), pa.array(np.concatenate(one)), pa.array(np.concatenate(two)), *(_lists(x) for x in lists)]

    return map_text(docs, "text", "n long, s1 long, s2 long, rare array<long>, common array<long>", compute, keep)


def _identity(bounds: np.ndarray, hashes: np.ndarray, salt: int) -> np.ndarray:
    sums = np.append(np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(salt))))
    return mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ np.diff(bounds).astype(np.uint64)).view(np.int64)


def _lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    ends = np.append(0, np.cumsum(np.concatenate([c for c, _ in parts])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([v for _, v in parts]).view(np.int64)))


def signed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Adds s1 and s2 (as keyed does) and two bitmaps, powers of two of bits: `bits`, at least SHINGLE_BITS for each shingle,
    and `thin`, the same in NARROWER times fewer."""

    def compute(column: pa.Array) -> list[pa.Array]:
        one, two, bits, thin = [], [], [], []
        for _, _, bounds, hashes in shingle_sets(column):
            one.append(_identity(bounds, hashes, 0x9FB21C651E98DF25))
            two.append(_identity(bounds, hashes, 0xD6E8FEB86659FD93))
            wide = [_bitmap(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            bits += [x.tobytes() for x in wide]
            thin += [_fold(x, _narrow(len(x))).tobytes() for x in wide]
        return [pa.array(np.concatenate(one)), pa.array(np.concatenate(two)), pa.array(bits, pa.binary()), pa.array(thin, pa.binary())]

    return map_text(docs, "text", "s1 long, s2 long, bits binary, thin binary", compute, keep)


def _matches(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def _one_set(text: str | None) -> np.ndarray:
    for _, _, _, hashes in shingle_sets(pa.array([text], pa.string())):
        return hashes
    return np.zeros(0, np.uint64)


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    width = max(LEAST_BITS, 1 << int(SHINGLE_BITS * len(hashes) - 1).bit_length()) if len(hashes) else LEAST_BITS
    bits = np.zeros(width, np.uint8)
    bits[(hashes >> np.uint64(20)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (in the last axis) of the same sets in fewer words; both counts are powers of two."""
    return np.bitwise_or.reduce(bits.reshape(*bits.shape[:-1], -1, words), axis=-2)


def _narrow(words: int) -> int:
    """64-bit words of an inner node's bitmap over sets whose bitmaps have `words`."""
    return max(LEAST_BITS // 64, words // NARROWER)


def need(n, m):
    """The least overlap with which sets of n and m shingles match."""
    return (PERCENT * (n + m) + 99 + PERCENT) // (100 + PERCENT)


def _node(sizes: np.ndarray, bits: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Least size, greatest size, greatest excess of shingles over bits, and OR-ed bitmap of the runs that start at cuts."""
    spare = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    return np.minimum.reduceat(sizes, cuts), np.maximum.reduceat(sizes, cuts), np.maximum.reduceat(spare, cuts), np.bitwise_or.reduceat(bits, cuts, axis=0)


def may_match(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether nodes (as _node has them, row by row) can hold sets that match.

    Shared shingles set bits that both have. A set of n shingles and k bits has at most n - k shingles more than it has bits
    among any of its bits, so an overlap is at most the common bits and that excess.
    """
    (low_x, high_x, spare_x, bits_x), (low_y, high_y, spare_y, bits_y) = x, y
    fits = (100 * high_x >= PERCENT * low_y) & (100 * high_y >= PERCENT * low_x)
    n = np.maximum(low_x, (PERCENT * low_y + 99) // 100)
    m = np.maximum(low_y, (PERCENT * low_x + 99) // 100)
    at_most = np.bitwise_count(bits_x & bits_y).sum(axis=-1, dtype=np.int64) + np.minimum(spare_x, spare_y)
    return fits & (at_most >= need(n, m))


def signature_tree(sizes: np.ndarray, bits: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Levels from single sets up to the root: FAN nodes of a level, LEAF at the lowest, make one of the next."""
    levels = [_node(sizes, bits, np.arange(len(sizes)))]
    step = LEAF
    while len(levels[-1][0]) > 1:
        low, high, spare, joined = levels[-1]
        cuts = np.arange(0, len(low), step)
        levels.append((np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(spare, cuts), np.bitwise_or.reduceat(joined, cuts, axis=0)))
        step = FAN
    return levels


def _near(sizes: np.ndarray, bits: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the pairs of sets (x, y), those that may match by their own bitmaps."""
    nodes = _node(sizes, bits, np.arange(len(sizes)))
    return np.concatenate([np.zeros(0, bool), *(may_match(tuple(v[x[a : a + 65536]] for v in nodes), tuple(v[y[a : a + 65536]] for v in nodes)) for a in range(0, len(x), 65536))])


def tree_pairs(sizes: np.ndarray, bits: np.ndarray, classes: np.ndarray, split: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of different classes that may match, by dual traversal from the roots.

    With `split`, pairs of a set below it and one from it on, else of any two. Sets should come in the order of their sizes.
    The trees hold folded bitmaps; pairs of leaves are tested by the whole ones too.
    """
    thin = _fold(bits, _narrow(bits.shape[1]))
    if split:
        one, two = signature_tree(sizes[:split], thin[:split]), signature_tree(sizes[split:], thin[split:])
    else:
        one = two = signature_tree(sizes, thin)
    d, e = len(one) - 1, len(two) - 1
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(x):
        keep = np.concatenate([may_match(tuple(v[x[a : a + 65536]] for v in one[d]), tuple(v[y[a : a + 65536]] for v in two[e])) for a in range(0, len(x), 65536)])
        x, y = x[keep], y[keep]
        if not d and not e:
            break
        down_x, down_y = d >= e, e >= d  # the taller tree goes down alone until both are as high
        if down_x:
            x, y = _descend(x, y, LEAF if d == 1 else FAN, len(one[d - 1][0]))
        if down_y:
            y, x = _descend(y, x, LEAF if e == 1 else FAN, len(two[e - 1][0]))
        d, e = d - down_x, e - down_y
        if one is two:
            x, y = x[x <= y], y[x <= y]
    y = y + split
    keep = classes[x] != classes[y]
    x, y = x[keep], y[keep]
    keep = _near(sizes, bits, x, y)
    return x[keep], y[keep]


def _descend(x: np.ndarray, y: np.ndarray, fan: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pair's first node replaced by its children."""
    children = (x[:, None] * fan + np.arange(fan)).ravel()
    return children[children < count], np.repeat(y, fan)[children < count]


def _matrix(rows: list[np.ndarray], words: int) -> np.ndarray:
    """Bitmaps in one matrix, folded to `words`."""
    return np.stack([_fold(r, words) if len(r) > words else r for r in rows])


def bucket_pairs(sizes: np.ndarray, sides: np.ndarray, classes: np.ndarray, bits: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of different classes that may match, and their estimated likeness; where there are two sides, of
    one set of either. Bitmaps are compared at one width: those of matching sets have the same or the next."""
    rows = [np.frombuffer(b, np.uint64) for b in bits]
    width = np.array([len(r) for r in rows])
    found: list[tuple[np.ndarray, ...]] = []
    two = len(np.unique(sides)) > 1
    for words in np.unique(width):
        same, next_ = (np.flatnonzero(width == w) for w in (words, 2 * words))
        meetings = [(same, None), (same, next_)]
        if two:
            meetings = [(x[sides[x] == s], y[sides[y] != s]) for x, y, s in ((same, same, 0), (same, next_, 0), (same, next_, 1))]
        for x, y in meetings:
            if not len(x) or (y is not None and not len(y)) or len(np.unique(classes[x if y is None else np.concatenate([x, y])])) < 2:
                continue
            at = x if y is None else np.concatenate([x, y])
            own = _matrix([rows[k] for k in at], int(words))
            a, b = tree_pairs(sizes[at], own, classes[at], 0 if y is None else len(x))
            common = np.concatenate([np.zeros(0), *(np.bitwise_count(own[a[k : k + 65536]] & own[b[k : k + 65536]]).sum(axis=1) for k in range(0, len(a), 65536))])
            found.append((at[a], at[b], common / (sizes[at[a]] + sizes[at[b]])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def forest(a: np.ndarray, b: np.ndarray, classes: np.ndarray, likeness: np.ndarray) -> np.ndarray:
    """Places of the pairs of a spanning forest over classes, likeliest pairs first."""
    low, high = np.minimum(classes[a], classes[b]), np.maximum(classes[a], classes[b])
    order = np.lexsort((-likeness, high, low))
    order = order[np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))] if len(order) else order
    order = order[np.argsort(-likeness[order], kind="stable")]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    kept = []
    for k, x, y in zip(order.tolist(), low[order].tolist(), high[order].tolist(), strict=True):
        if (u := root(x)) != (v := root(y)):
            parent[u] = v
            kept.append(k)
    return np.array(kept, np.int64)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the least id that each id of `links` (a, b) reaches.

    Large-star and small-star steps in turn until nothing moves; each round is a written table. Every id has at most one
    row for each of its links, and minima are taken with partial aggregation, so a hub's rows meet pre-aggregated.
    """
    if links.isEmpty():
        return materialize(links.select(F.col("a").alias("id"), F.col("b").alias("component")), "components")
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    mark = None
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: neighbours above a node, to the least of its neighbourhood.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "large-star")
        # Small star: neighbours below a node, and itself, to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        small = materialize(small.where("u != v").distinct(), "small-star")
        drop(edges, large)
        edges = small
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = materialize(stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct()), "components")
    drop(edges)
    return out


_IDS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def verified(pairs: DataFrame, texts: DataFrame, sift: bool) -> DataFrame:
    """Of `pairs` (a, b), those whose whole sets match; `texts` has id, n, text, thin. With `sift`, thin bitmaps part most
    others before any text moves. Pairs of one a should be many: its text goes once to each HUB_PAIRS of them."""
    if sift:
        side = lambda name: texts.select(F.col("id").alias(name), F.col("n").alias(f"{name}_n"), F.col("thin").alias(f"{name}_thin"))
        rough = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "b_n", "a_thin", "b_thin")

        def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for a, b, n, m, u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    rows = [np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)]
                    bits, sizes = _matrix(rows, min(map(len, rows))), np.array([n, m])
                    x, y = (_node(sizes[k : k + 1], bits[k : k + 1], np.zeros(1, np.int64)) for k in (0, 1))
                    if may_match(x, y)[0]:
                        out.append((a, b))
                yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], _IDS)

        pairs = materialize(rough.mapInArrow(parted, "a long, b long"), "close-pairs")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("parts"))
    hubs = hubs.join(texts.select(F.col("id").alias("a"), "text"), "a").select("a", F.lit(None).cast("long").alias("b"), "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("parts"))
    spokes = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    spokes = spokes.join(texts.select(F.col("id").alias("b"), "text"), "b").select("a", "b", "text", "part")
    dealt = hubs.unionByName(spokes).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for a, b, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if b is None:
                        hub, held = a, _one_set(text)
                    elif a != hub:
                        raise RuntimeError(f"pairs of {a} came without its text")
                    elif _matches(held, _one_set(text)):
                        out.append({"a": a, "b": b})
                yield pa.RecordBatch.from_pylist(out, _IDS)
        give_back()

    out = materialize(dealt.select("a", "b", "text").mapInArrow(check, "a long, b long"), "verified-pairs")
    drop(*[pairs] * sift)
    return out


def _buckets(sets: DataFrame) -> DataFrame:
    """Bucket rows (key, id, n) of buckets with two sets and more; of buckets with the same sets, one."""
    rare = sets.select("id", "n", F.explode("rare").alias("key")).withColumn("c", F.count("*").over(Window.partitionBy("key"))).where("c > 1").select("key", "id", "n")
    # Common shingles can have any number of rows: counted with partial aggregates, joined with both sides shuffled.
    common = materialize(sets.select("id", "n", F.explode("common").alias("key")), "common-keys")
    counted = materialize(common.groupBy("key").count().where("count > 1").select("key"), "common-counts")
    rows = materialize(rare.unionByName(common.join(counted, "key").select("key", "id", "n")), "bucket-rows")
    alike = rows.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("h1"), F.sum(F.xxhash64(F.lit(3), "id").cast("decimal(20,0)")).alias("h2"))
    kept = materialize(alike.groupBy("c", "h1", "h2").agg(F.min("key").alias("key")).select("key", "c"), "bucket-heads")
    return materialize(rows.join(kept, "key").select("key", "id", "n", "c"), "buckets")


def _tree_candidates(rows: DataFrame, texts: DataFrame, spanning: bool) -> DataFrame:
    """Pairs (a, b) of rows (key, id, n, c, component) that the signature trees leave; with `spanning`, a forest of them for
    each bucket or pair of blocks."""
    small = rows.where(F.col("c") <= BLOCK).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "id", "n", "component")
    large = rows.where(F.col("c") > BLOCK)
    # Blocks of a large bucket hold sets of like size; a block's number follows from its sets' ranks among size steps, which
    # are counted for each step and not row by row.
    steps = large.withColumn("step", F.floor(F.log("n") * 64)).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(1 << 20)))
    sized = steps.groupBy("key", "step").agg(F.count("*").alias("m"), F.min("n").alias("low"), F.max("n").alias("high"))
    blocks = materialize(sized.withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int")), "bucket-blocks")
    labelled = materialize(
        steps.join(blocks.select("key", "step", "parts"), ["key", "step"]).withColumn("block", F.struct("step", F.pmod("salt", F.col("parts")).alias("part"))).select("key", "block", "id", "n", "component"), "block-rows"
    )
    nodes = blocks.select("key", "low", "high", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct("step", k.cast("long").alias("part")))).alias("block"))
    x, y = nodes.alias("x"), nodes.alias("y")
    meet = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") <= F.col("y.block")) & (100 * F.col("x.high") >= PERCENT * F.col("y.low")))
    meet = materialize(meet.select(F.col("x.key").alias("key"), F.col("x.block").alias("bx"), F.col("y.block").alias("by")).withColumn("i", F.xxhash64("bx")).withColumn("j", F.xxhash64("by")), "block-pairs")
    first = labelled.join(meet.select("key", F.col("bx").alias("block"), "i", "j"), ["key", "block"]).withColumn("side", F.lit(0))
    second = labelled.join(meet.where("bx != by").select("key", F.col("by").alias("block"), "i", "j"), ["key", "block"]).withColumn("side", F.lit(1))
    columns = ["key", "i", "j", "side", "id", "n", "component"]
    dealt = small.withColumns({"i": F.col("i").cast("long"), "j": F.col("j").cast("long")}).unionByName(first.select(columns)).unionByName(second.select(columns))
    dealt = dealt.join(texts.select("id", "bits"), "id")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve(group: list[tuple]) -> pa.RecordBatch | None:
            if len({r[3] for r in group}) < 2:
                return None
            sides, names, sizes, classes = (np.array([r[k] for r in group], np.int64) for k in range(4))
            a, b, likeness = bucket_pairs(sizes, sides, classes, [r[4] for r in group])
            if not len(a):
                return None
            if spanning:
                kept = forest(a, b, classes, likeness)
                a, b = a[kept], b[kept]
            a, b = names[a], names[b]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_IDS)

        now = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "i", "j", "side", "id", "n", "component", "bits")]
            for key, i, j, *row in zip(*columns, strict=True):
                if (key, i, j) != now:
                    if len(held) > 1 and (out := solve(held)) is not None:
                        yield out
                    now, held = (key, i, j), []
                held.append(tuple(row))
        if len(held) > 1 and (out := solve(held)) is not None:
            yield out
        give_back()

    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "n", "id")
    return ordered.select("key", "i", "j", "side", "id", "n", "component", "bits").mapInArrow(traverse, "a long, b long").distinct()


def clusters(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, component) of every id that a verified link reaches. `buckets` has key, id, n and c (sets in the bucket);
    `texts` has id, n, text, bits, thin of every id in a bucket. Both are tables of materialize() and are dropped."""
    if buckets.isEmpty():
        drop(buckets, texts)
        return materialize(buckets.sparkSession.createDataFrame([], "id long, component long"), "components")
    # The set that shares most buckets with others leads its buckets: of edited copies, that is the text least edited.
    weights = materialize(buckets.groupBy("id").agg(F.sum("c").alias("w")), "bucket-weights")
    leads = materialize(buckets.join(weights, "id").groupBy("key").agg(F.max_by("id", F.struct("w", "id")).alias("lead")), "bucket-leads")
    pairs = materialize(buckets.join(leads, "key").where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "star-pairs")
    drop(weights, leads)
    links = verified(pairs, texts, True)
    tried = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried-pairs")
    drop(pairs)
    for spanning in (True, False):
        joined = components(links)
        labelled = materialize(buckets.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")), "bucket-components")
        drop(joined)
        open_ = materialize(labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key"), "open-buckets")
        rows = materialize(labelled.join(open_, "key"), "open-rows")
        drop(labelled, open_)
        if rows.isEmpty():
            drop(rows)
            break
        pairs = materialize(_tree_candidates(rows, texts, spanning).join(tried, ["a", "b"], "left_anti"), "tree-pairs")
        drop(rows)
        if not pairs.isEmpty():
            more = verified(pairs, texts, False)
            both, before = materialize(links.unionByName(more), "links"), tried
            tried = materialize(before.unionByName(pairs), "tried-pairs")
            drop(links, more, before)
            links = both
        drop(pairs)
    drop(tried, buckets, texts)
    out = components(links)
    drop(links)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): doc_id, n_shingles, component_id.

    A text without words has no shingles and its own id as component; so has a document that links with none. Each text is
    a node of its own: rows that share an id are linked only if their texts are, and repeated rows are copies. A null id is
    no one's component: rows without id link like others, and have a null component where no linked row has an id. An empty
    table gives no rows. A text may have any length; it is held whole by one task at a time.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    full = materialize(keyed(docs, ["id"]), "keyed")
    rows = materialize(full.select("id", "n", "s1", "s2"), "set-names")
    found = full.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("n", "rare", "common")).alias("x"), F.min("id").alias("own"))
    # Sets are named by a number of their own, for an id may stand for several texts.
    sets = materialize(found.select(F.monotonically_increasing_id().alias("id"), "s1", "s2", "own", "x.*"), "sets")
    drop(full)
    buckets = _buckets(sets)
    named = materialize(sets.select("id", "s1", "s2", "own", "n"), "named-sets")
    drop(sets)
    wanted = materialize(buckets.select("id").distinct().join(named, "id").withColumnsRenamed({"s1": "w1", "s2": "w2"}), "wanted-sets")
    bare = signed(docs.withColumnRenamed("id", "doc"), ["doc", "text"])
    mine = (F.col("s1") == F.col("w1")) & (F.col("s2") == F.col("w2")) & F.col("doc").eqNullSafe(F.col("own"))
    texts = materialize(bare.join(wanted, mine).select("id", "n", "text", "bits", "thin").dropDuplicates(["id"]), "wanted-texts")
    drop(wanted)
    found = clusters(buckets, texts)
    labels = named.join(found, "id", "left").select("s1", "s2", "own", F.coalesce("component", "id").alias("component"))
    least = labels.groupBy("component").agg(F.min("own").alias("component_id"))
    by_set = materialize(labels.join(least, "component").select("s1", "s2", "component_id"), "set-components")
    drop(named, found)
    out = rows.join(by_set, ["s1", "s2"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def op10_neardups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component: doc_id, n_shingles, component_id."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
