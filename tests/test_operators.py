"""Planted cases and properties of the operators."""

import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mirrorfall.functions import bits, globs, paths, scoring
from mirrorfall.operators import cache, corpora, groups, keepers, similarity
from mirrorfall.plans.scan import ScanConfig, read_results, scan, write_report
from mirrorfall.sources.formats import fingerprint, hash_files, with_fingerprint
from mirrorfall.sources.inventory import read_inventory
from mirrorfall.sources.mounts import read_mounts

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def as_sets(df):
    return {frozenset(r.files) for r in df.collect()}


@QUIET
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from([0, 1, 64, 100])), min_size=1, max_size=25))
def test_groups_are_the_planted_classes(spark, universe):
    rows = [(f"/d/{i}", size, bytes([cls]) * size) for i, (cls, size) in enumerate(universe)]
    df = spark.createDataFrame(rows, "path string, size bigint, content binary")
    planted = {}
    for path, _, content in rows:
        planted.setdefault(content, set()).add(path)
    want = {frozenset(v) for v in planted.values() if len(v) > 1}
    assert as_sets(groups.exact_groups(df)) == want
    assert as_sets(groups.exact_groups(df.repartition(7))) == want
    tiers = groups.tiered(df, tier1_bytes=8, floor=64, window=16)
    full = {}
    for r in tiers["full"].collect():
        full.setdefault((r["size"], r.t3), set()).add(r.path)
    assert {frozenset(v) for v in full.values()} == want


def test_tiers_part_what_differs_late(spark):
    base = bytearray(b"x" * 4096)
    middle, tail = bytearray(base), bytearray(base)
    middle[2048], tail[-1] = 1, 2
    rows = [("/a", bytes(base)), ("/b", bytes(base)), ("/c", bytes(middle)), ("/d", bytes(tail))]
    df = spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, size bigint, content binary")
    tiers = groups.tiered(df, tier1_bytes=64, floor=1024, window=64)
    assert [tiers[t].count() for t in ("size", "head", "sampled", "full")] == [4, 4, 2, 2]


def test_tiers_slice_bytes_not_characters(spark):
    long = "é" * 600
    texts = {"/a": "é" * 32 + "a" * 20, "/b": "é" * 32 + "b" * 20, "/c": long, "/d": long, "/e": long[:300] + "è" + long[301:]}
    df = spark.createDataFrame(list(texts.items()), "path string, content string").withColumn("size", F.octet_length("content").cast("bigint"))
    tiers = groups.tiered(df, tier1_bytes=64, floor=1024, window=64)
    left = {t: {r.path for r in tiers[t].collect()} for t in ("head", "sampled", "full")}
    assert left == {"head": set(texts), "sampled": {"/a", "/b", "/c", "/d"}, "full": {"/c", "/d"}}
    counted = {r.tier: (r.files, r.bytes_read) for r in groups.tier_counters(df, tiers, tier1_bytes=64, window=64, floor=1024).collect()}
    assert counted == {"head": (5, 320), "sampled": (3, 576), "full": (4, 2568)}


def test_sizes_are_bytes_not_characters(spark):
    df = spark.createDataFrame([("/a", "éé"), ("/b", "abcd"), ("/c", "éé")], "path string, content string").withColumn("size", F.octet_length("content").cast("bigint"))
    assert as_sets(groups.exact_groups(df)) == {frozenset({"/a", "/c"})}


@QUIET
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), min_size=2, max_size=20), st.integers(0, 7))
def test_hamming_join_is_exact(spark, seeds, tau):
    values = seeds + [s ^ 5 for s in seeds[:5]]
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, fp bigint")
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if bin((values[i] ^ values[j]) & (1 << 64) - 1).count("1") <= tau}
    assert {(r.a, r.b) for r in similarity.hamming_pairs(df, tau).collect()} == want


@pytest.mark.parametrize("tau", [0, 1, 2, 3])
def test_array_hamming_join_is_exact(spark, tau):
    rng = random.Random(tau)
    values = [[rng.getrandbits(10) - 300 for _ in range(rng.randint(0, 5))] for _ in range(40)]
    values += [[x ^ (1 << rng.randrange(10)) ^ (rng.getrandbits(1) << rng.randrange(10)) ^ (1 << rng.randrange(10) if tau > 1 else 0) for x in v] + [7] * rng.randint(0, 1) for v in values * 2]
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, fp array<int>")
    differ = lambda x, y: bin((x ^ y) & (1 << 64) - 1).count("1")
    mean = lambda a, b: sum(map(differ, a, b)) / min(len(a), len(b))
    pairs = [(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if values[i] and values[j]]
    want = {(i, j, mean(values[i], values[j])) for i, j in pairs if mean(values[i], values[j]) <= tau}
    assert tau == 0 or len(want) > 20
    found = [tuple(r) for r in similarity.array_hamming_pairs(df, tau).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_arrays_with_unused_high_bits_rarely_meet(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, [rng.getrandbits(10) for _ in range(8)]) for i in range(400)], "id bigint, fp array<int>")
    one, other = similarity.array_hamming_keys(df, 1)
    met = one.alias("a").join(other.alias("b"), ["at", "band", "bits"]).where("a.k < b.k").select("a.k", "b.k").distinct()
    assert met.count() < 400 * 399 // 2 // 20


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    found = {r.id: r.component for r in similarity.components(links).collect()}
    assert all(found[i] == 0 for i in range(61)) and found[101] == 100


def test_cohesion_drops_a_chain(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0b111), (2, 0b111111), (3, 0b111111111)], "id bigint, fp bigint")
    clusters = similarity.components(similarity.hamming_pairs(rows, 3))
    assert similarity.cohesive(clusters, rows, 3).count() == 0
    assert similarity.cohesive(clusters, rows, 5).first().diameter == 9


def test_keeper_ties_keep_the_first(spark):
    rows = spark.createDataFrame([(1, 0, "/b", 5, False), (1, 1, "/a", 5, False), (1, 2, "/cc", None, False), (1, 3, "/r", 9, True)], "g int, ordinal bigint, path string, mtime_unix bigint, is_reference boolean")
    plain = rows.where("not is_reference")
    for strategy in ("first", "oldest", "newest", "shortest"):
        assert keepers.pick_keeper(plain, ["g"], strategy).where("is_keeper").first().path == "/b"
    assert keepers.pick_keeper(rows, ["g"], "oldest").where("is_keeper").first().path == "/r"
    assert keepers.pick_keeper(plain, ["g"], "in-reference").count() == 0
    with pytest.raises(ValueError):
        keepers.pick_keeper(rows, ["g"], "smart")


def test_system_paths_refuse_the_group(spark):
    rows = spark.createDataFrame([(1, 0, "/home/a", 1, False), (1, 1, "/etc/a", 1, False), (2, 0, "/home/x", 1, False)], "g int, ordinal bigint, path string, mtime_unix bigint, is_reference boolean")
    rows = rows.withColumns({"size": F.lit(5), "current_size": F.lit(5), "decode_warning": F.lit(False), "placeholder": F.lit("none"), "volume": F.lit("v"), "file_ref": F.col("ordinal")})
    plan = keepers.plan_actions(keepers.pick_keeper(rows, ["g"]), ["g"], "hardlink").collect()
    assert [(r.path, r.outcome) for r in plan] == [("/etc/a", "refused_system_path")]


def test_parent_chains(spark):
    rows = [(1, None, "root"), (2, 1, "a"), (3, 2, "b"), (4, 99, "lost"), (5, 6, "x"), (6, 5, "y"), (7, 7, "self")] + [(100 + i, 3 if i == 0 else 99 + i, f"n{i}") for i in range(40)]
    found = {r.file_ref: (r.path, r.hops, r.status) for r in cache.parent_paths(spark.createDataFrame(rows, "file_ref bigint, parent_ref bigint, name string")).collect()}
    assert found[3] == ("root/a/b", 2, "ok") and found[7][0] == "self"
    assert found[4][2] == "missing_parent" and found[5][2] == "cycle"
    assert found[139][1] == 42


def test_change_feed_applies_the_last_change(spark):
    snap = spark.createDataFrame([(1, "a"), (2, "b")], "file_ref bigint, name string")
    feed = spark.createDataFrame([(1, "a2", 5, False), (1, "a1", 4, False), (2, None, 6, True), (3, "c", 7, True), (3, "c", 8, False)], "file_ref bigint, name string, usn bigint, deleted boolean")
    assert {tuple(r) for r in cache.merge_changes(snap, feed).collect()} == {(1, "a2"), (3, "c")}


def test_hash_cache_versions(spark, tmp_path):
    store = cache.HashCache(spark, str(tmp_path / "cache"))
    row = lambda size, t1, t3: spark.createDataFrame([("v", 1, "sha", size, 1, 1, t1, None, t3)], "volume string, file_ref bigint, hash_algo string, size bigint, mtime_ticks bigint, usn bigint, t1 string, t2 string, t3 string")
    assert store.read() is None
    store.write(row(5, "x", "full"))
    store.write(row(5, None, None))
    assert store.read().first().t3 == "full"
    store.write(row(6, "y", None))
    assert store.read().first().t3 is None
    assert store.vacuum() == 2 and store.info() == {"versions": 1, "rows": 1}


def test_globs():
    import re

    crossing, bounded = (re.compile(globs.glob_regex("*/x*.txt", s)) for s in (False, True))
    assert crossing.match("a/b/x1.txt") and not bounded.match("a/b/x1.txt") and bounded.match("b/x1.txt")
    deep = re.compile(globs.glob_regex("**/target/**", True))
    assert deep.match("a/b/target/c/d") and deep.match("target/c") and not deep.match("a/targets/c")


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(paths.extension(F.lit("/a/.bashrc"))) is None and one(paths.extension(F.lit("/a/x."))) == "" and one(paths.extension(F.lit("/a/B.TXT"))) == "txt"
    assert one(paths.display(F.lit("\\\\?\\UNC\\srv\\s"))) == "\\\\srv\\s" and one(paths.display(F.lit("\\\\?\\C:\\x"))) == "C:\\x"
    assert one(paths.under_root(F.lit("/a/bc"), F.lit("/a/b"))) is False and one(paths.under_root(F.lit("/a/b/c"), F.lit("/a/b/"))) is True
    assert one(scoring.keep_score(F.lit("/$RECYCLE.BIN/a"), F.lit(None).cast("bigint"), F.lit(0))) == -100.0
    assert one(scoring.keep_score(F.lit("/a/b/c/d (9).txt"), F.lit(None).cast("bigint"), F.lit(0))) == 2 - 12.0
    assert one(bits.average_hamming(F.array(F.lit(1), F.lit(3)), F.array(F.lit(0)))) == 1.0
    assert paths.parse_size("4K") == 4096 and paths.parse_size("1.5 MiB") == 1_572_864
    with pytest.raises(ValueError):
        paths.parse_size("x")


def test_inventory_source(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    for name, data in (("a.bin", b"x" * 9), ("sub/.hidden", b""), ("sub/deep/b.bin", b"x" * 9), ("sub/_c", b"y"), ("z.mirrorfall", b"")):
        (tmp_path / name).write_bytes(data)
    os.link(tmp_path / "a.bin", tmp_path / "sub" / "linked")
    os.symlink(tmp_path / "a.bin", tmp_path / "soft")
    os.symlink(tmp_path, tmp_path / "sub" / "loop")
    rows = read_inventory(spark, [str(tmp_path)]).collect()
    assert sorted(os.path.relpath(r.path, tmp_path) for r in rows) == ["a.bin", "sub/.hidden", "sub/_c", "sub/deep/b.bin", "sub/linked"]
    assert len({r.file_ref for r in rows if r["size"] == 9}) == 2
    with pytest.raises(FileNotFoundError):
        read_inventory(spark, [str(tmp_path / "none")])
    hashed = {os.path.basename(r.path): r.hash for r in hash_files(read_inventory(spark, [str(tmp_path)])).collect()}
    assert hashed["a.bin"] == hashed["b.bin"] == hashed["linked"] != hashed["_c"]


def test_format_fingerprints(spark, tmp_path):
    import io
    import zipfile

    def packed(order, comment=b""):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in order:
                z.writestr(zipfile.ZipInfo(n), n * 3)
            z.comment = comment
        return out.getvalue()

    assert fingerprint("/x/a.zip", packed("ab")) == fingerprint("/y/b.ZIP", packed("ba", b"note")) is not None
    assert fingerprint("/x/a.zip", b"junk") is None and fingerprint("/x/a.txt", b"") is None and fingerprint(None, None) is None
    df = spark.createDataFrame([("/x/a.zip", packed("ab")), ("/x/b.pdf", b"%PDF-1.4 startxref\n0\n%%EOF"), ("/x/c", None)], "path string, content binary")
    assert [r.t0 is None for r in with_fingerprint(df).collect()] == [False, False, True]


def test_mounts(spark, tmp_path):
    (tmp_path / "mounts").write_text("/dev/sda1 / ext4 rw 0 0\nsrv:/x /mnt/my\\040share nfs rw 0 0\nbad\n")
    assert [r.mountpoint for r in read_mounts(spark, str(tmp_path / "mounts")).collect()] == ["/", "/mnt/my share"]


def test_scan_and_reports(spark, tmp_path):
    rows = [("/r/a", "xx"), ("/r/b", "xx"), ("/k/c", "yy"), ("/k/d", "yy"), ("/k/e", "z")]
    inv = spark.createDataFrame(rows, "path string, content string").withColumn("size", F.octet_length("content").cast("bigint"))
    result = scan(inv, ScanConfig(reference_roots=["/r"]))
    assert as_sets(result.groups) == {frozenset({"/k/c", "/k/d"})}
    for kind in ("json", "csv", "text", "markdown"):
        write_report(result, str(tmp_path / kind), kind)
    assert read_results(spark, str(tmp_path / "json")).first().files == ["/k/c", "/k/d"]
    empty = scan(inv.where("false"), ScanConfig())
    assert empty.summary.first().groups == 0


def test_sample_is_deterministic(spark):
    a, b = (corpora.sample(spark, "s", 50, 50).collect() for _ in range(2))
    assert a == b and sorted(r.value for r in a) == list(range(50))
