"""Labels, outcomes, restores, fallbacks and other small operators on planted rows."""

import pytest
from pyspark.sql import functions as F

from mirrorfall.functions import labels
from mirrorfall.operators import cache, corpora, history, keepers, metrics


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_thresholds():
    assert labels.threshold("AUTO", 4) == 4 and labels.threshold("7", 4) == 7
    for odd in ("", "-1", "1.5", "automatic"):
        with pytest.raises(ValueError):
            labels.threshold(odd, 4)


def test_categories_and_drives(spark):
    assert one(spark, labels.category_label(F.lit("lifetime-reclaimed"))) == "Lifetime reclaimed"
    assert one(spark, labels.category_label(F.lit("new_kind-of"))) == "New Kind Of"
    paths = {r"\\?\c:\a": "C:", "e:/x": "E:", r"\\Srv\Share\a\b": r"\\Srv\Share", "/home/u": "home", "/": ""}
    for path, drive in paths.items():
        assert one(spark, labels.drive_id(F.lit(path))) == drive


def test_own_source_is_told_by_name_or_by_two_files(spark):
    def recursive(*paths):
        df = spark.createDataFrame([(p, 0) for p in paths], "path string, mtime_unix bigint")
        return {r.predicate: r.granted for r in metrics.predicates(df, 0).collect()}

    assert recursive("/x/mirrorfall/a")["recursive"] and recursive("/x/__spark_entry__.py", "/x/m/plans/catalogue.py")["recursive"]
    assert not recursive("/x/__spark_entry__.py", "/x/mirrorfallen/a")["recursive"]
    assert recursive("/x/ShaderCache/a")["shadercache-hoarder"] is True and recursive()["shadercache-hoarder"] is None


def test_outcomes_leave_groups_of_two(spark):
    members = spark.createDataFrame([(1, "/a"), (1, "/b"), (1, "/c"), (2, "/d"), (2, "/e"), (3, "/f"), (3, "/g")], "g int, path string")
    done = spark.createDataFrame([("/a", "removed", None), ("/b", "renamed", "/b.bak"), ("/d", "storage_deduplicated", None), ("/z", "removed", None)], "path string, outcome string, new_path string")
    left = keepers.apply_outcomes(members, ["g"], done)
    assert {tuple(r) for r in left.collect()} == {(1, "/b.bak"), (1, "/c"), (3, "/f"), (3, "/g")}
    assert {r.path for r in keepers.in_drive_scope(members, ["g"], "/d", ["/a"]).collect()} == {"/a", "/b", "/c", "/d", "/e"}
    assert keepers.in_drive_scope(members, ["g"], None).count() == 7


def test_keeper_changes_place_with_the_first(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], "c"), (["a", "b"], "a"), (["a", "b"], "z"), ([], "z")], "files array<string>, keeper string")
    assert [r.files for r in keepers.keeper_first(df).collect()] == [["c", "b", "a", "d"], ["a", "b"], ["a", "b"], []]


def test_nothing_is_restored_over_a_file(spark):
    manifest = spark.createDataFrame([("/o/1", "/z/1", 5), ("/o/2", "/z/2", 6), ("/o/3", "/z/3", 7), ("/o/4", "/z/4", 8)], "original string, archived string, size bigint")
    there = spark.createDataFrame([("/z/1",), ("/z/2",), ("/o/2",), ("/o/3",), ("/z/4",), ("/z/4",)], "path string")
    plan = keepers.restore_plan(manifest, there)
    assert {r.original: r.outcome for r in plan.collect()} == {"/o/1": "restore", "/o/2": "original_exists", "/o/3": "archived_missing", "/o/4": "restore"}
    assert {r.outcome: (r.n, r.bytes) for r in keepers.restore_summary(plan).collect()} == {"restore": (2, 13), "original_exists": (1, 6), "archived_missing": (1, 7)}


def test_undone_renames_take_no_name(spark):
    names = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    out = keepers.undo_rename(names("/a.bak", "/b.bak", "/c"), names("/b"), ".bak")
    assert {tuple(r) for r in out.collect()} == {("/a.bak", "/a", "restore"), ("/b.bak", "/b", "refused_collision")}


def test_sums_fallbacks_and_shares(spark):
    row = lambda *x: [F.lit(v).cast("bigint") for v in x]
    cases = {(None, 1, 5, 1, 9, 0): "no_snapshot", (2, 1, 5, 1, 9, 0): "journal_replaced", (1, 1, 0, 1, 9, 0): "journal_truncated", (1, 1, 10, 1, 9, 0): "cursor_ahead", (1, 1, 5, 1, 9, 2): "unknown_parent", (1, 1, 5, 1, 9, 0): None}
    for given, want in cases.items():
        assert one(spark, cache.warm_fallback(*row(*given))) == want
    merged = one(spark, history.merge_sums(F.expr("map('a', 1, 'b', 2)"), F.expr("map('b', 3, 'c', 4)")))
    assert merged == {"a": 1, "b": 5, "c": 4}
    assert [one(spark, history.progress(F.lit(a), F.lit(b))) for a, b in ((1, 4), (9, 4), (1, 0))] == [0.25, 1.0, 0.0]
    parts = spark.range(1).select(*history.lifecycle(F.lit(10), F.lit(3), F.lit(2), F.lit(True))).first()
    assert tuple(parts) == (2, 3, 5)


def test_class_statistics(spark):
    df = spark.createDataFrame([(1 << 20, 10, 2, 1, 4), ((1 << 20) + 1, 4, 0, 1, 0)], "file_size bigint, file_count bigint, pairs bigint, big_sets bigint, big_size bigint")
    stats = corpora.class_stats(df)
    assert [(r.dups, r.originals, r.leaves) for r in stats.collect()] == [(5, 5, 10), (0, 4, 8)]
    assert corpora.largest_dupset(spark.range(0).withColumnRenamed("id", "n")).first().largest == 0
