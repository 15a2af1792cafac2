"""Which member of a group stays, reference members, and the guarded plan of actions for the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bits import blocks_action
from ..functions.paths import is_system_path, under_root
from ..functions.scoring import keep_score

STRATEGIES = ("first", "oldest", "newest", "shortest", "longest", "in-reference", "smart")
ACTIONS = {"remove": "bytes_removed", "recycle": "bytes_recycled", "hardlink": "bytes_hardlinked", "reflink": "bytes_reflinked", "archive": "bytes_archived"}


def mark_references(rows: DataFrame, roots: list[str] | DataFrame) -> DataFrame:
    """Adds is_reference: whether the path is a reference root or lies under one. Roots are a configured, short list."""
    names = roots if isinstance(roots, list) else [r.root for r in roots.select("root").toLocalIterator()]
    flag = F.lit(False)
    for name in names:
        flag = flag | under_root(F.col("path"), F.lit(name))
    return rows.withColumn("is_reference", F.coalesce(flag, F.lit(False)))


def drop_reference_only(rows: DataFrame, group: list[str]) -> DataFrame:
    """Members of groups with at least one member that is not a reference."""
    mixed = rows.groupBy(*group).agg(F.bool_or(~F.col("is_reference")).alias("m")).where("m").select(*group)
    return rows.join(mixed, group, "left_semi")


def _order(strategy: str, as_of: int | None) -> list[Column]:
    if strategy == "smart":
        if as_of is None:
            raise ValueError("the smart strategy needs as_of, in Unix seconds")
        score = F.round(keep_score(F.col("path"), F.col("mtime_unix"), F.lit(as_of)), 4)
        return [score.desc(), F.col("mtime_unix").desc_nulls_last()]
    return {
        "first": [],
        "in-reference": [],
        "oldest": [F.col("mtime_unix").asc_nulls_last()],
        "newest": [F.col("mtime_unix").desc_nulls_last()],
        "shortest": [F.octet_length("path").asc()],
        "longest": [F.octet_length("path").desc()],
    }[strategy]


def pick_keeper(rows: DataFrame, group: list[str], strategy: str = "first", as_of: int | None = None) -> DataFrame:
    """Members (ordinal, path, mtime_unix, is_reference, ...) with is_keeper and keeper_path.

    A reference member comes before any other, then the strategy's order, then the ordinal. Under in-reference, groups
    without a reference member have no keeper and are left out.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    w = Window.partitionBy(*group).orderBy(F.col("is_reference").desc(), *_order(strategy, as_of), F.col("ordinal"))
    out = rows.withColumn("is_keeper", F.row_number().over(w) == 1).withColumn("keeper_path", F.first("path").over(w))
    if strategy == "in-reference":
        out = out.withColumn("__any", F.bool_or("is_reference").over(Window.partitionBy(*group))).where("__any").drop("__any")
    return out


def plan_actions(rows: DataFrame, group: list[str], action: str = "hardlink", allow_system: bool = False, allow_dedup: bool = False, dry_run: bool = True) -> DataFrame:
    """Members with an outcome; the first guard that applies decides.

    rows are pick_keeper's, with size, current_size, decode_warning, placeholder, volume and file_ref. Groups of one member
    are left out. A system path anywhere in a group refuses it, with an outcome for the members that lie on one.
    """
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}")
    whole = Window.partitionBy(*group)
    keeper = lambda c: F.max(F.when(F.col("is_keeper"), F.col(c))).over(whole)
    rows = rows.withColumn("__n", F.count("*").over(whole)).where("__n >= 2")
    rows = rows.withColumns({"__system": is_system_path(F.col("path")), "__keeper_volume": keeper("volume"), "__keeper_ref": keeper("file_ref")})
    rows = rows.withColumn("__refused", F.bool_or("__system").over(whole) & ~F.lit(allow_system))
    same = (F.col("volume") == F.col("__keeper_volume")) & (F.col("file_ref") == F.col("__keeper_ref"))
    outcome = (
        F.when(F.col("__refused") & F.col("__system"), "refused_system_path")
        .when(F.col("__refused"), F.lit(None))
        .when(F.col("is_keeper"), "left_alone")
        .when(F.col("is_reference"), "skipped_reference")
        .when(~F.col("size").eqNullSafe(F.col("current_size")), "skipped_invalidated")
        .when(F.col("decode_warning") & F.lit(action == "remove"), "skipped_decode_warning")
        .when(blocks_action(F.col("placeholder"), allow_dedup), "refused_placeholder")
        .when(same, "already_hardlinked" if action == "hardlink" else "refused_keeper_identity")
        .when(F.col("file_ref").isNull() & F.lit(action == "remove"), "refused_keeper_unresolvable")
        .otherwise("dry_run_no_change" if dry_run else "planned")
    )
    planned = rows.withColumns({"action": F.lit(action), "outcome": outcome}).where("outcome is not null")
    return planned.select(*group, "ordinal", "path", "keeper_path", "action", "outcome", F.col("size").alias("size_bytes"))


def outcome_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("size_bytes").cast("bigint").alias("bytes"))


def locked_sums(plan: DataFrame) -> DataFrame:
    """key, bytes: what each action did or would do, under its report key."""
    key = F.lit(None).cast("string")
    for action, name in ACTIONS.items():
        key = F.when(F.col("action") == action, name).otherwise(key)
    done = plan.where(F.col("outcome").isin("dry_run_no_change", "planned", "executed"))
    return done.groupBy(key.alias("key")).agg(F.sum("size_bytes").cast("bigint").alias("bytes")).where("key is not null")


def bulk_plan(groups: DataFrame, hide_unreclaimable: bool = True) -> DataFrame:
    """group columns, keeper and targets: the first file stays, the others go; groups without targets are dropped."""
    out = groups.withColumns({"keeper": F.get("files", F.lit(0)), "targets": F.slice("files", F.lit(2), F.greatest(F.size("files") - 1, F.lit(0)))})
    return out.where((F.size("targets") > 0) & (F.lit(not hide_unreclaimable) | (F.col("size") > 0)))


def undo_rename(paths: DataFrame, existing: DataFrame, suffix: str) -> DataFrame:
    """path, restored, outcome: names without the suffix, refused where that name is taken."""
    bare = F.when(F.col("path").endswith(suffix), F.expr(f"left(path, length(path) - {len(suffix)})"))
    plan = paths.select("path", bare.alias("restored")).where("restored is not null")
    taken = existing.select(F.col("path").alias("restored"), F.lit(True).alias("taken")).distinct()
    return plan.join(taken, "restored", "left").select("path", "restored", F.when(F.col("taken"), "refused_collision").otherwise("restore").alias("outcome"))


def keeper_first(groups: DataFrame, keeper: str = "keeper") -> DataFrame:
    """`files` with the keeper and the first file in each other's place; unchanged where the keeper is not among them."""
    at = F.array_position("files", F.col(keeper))
    swapped = F.transform("files", lambda x, i: F.when(i == 0, F.col(keeper)).when(i == at - 1, F.get("files", F.lit(0))).otherwise(x))
    return groups.withColumn("files", F.when(at > 0, swapped).otherwise(F.col("files")))


def apply_outcomes(members: DataFrame, group: list[str], outcomes: DataFrame) -> DataFrame:
    """Members after actions (path, outcome, new_path): renamed ones have their new path; removed and storage_deduplicated ones
    are gone, and so are groups that fewer than two members are left of."""
    done = outcomes.select("path", F.col("outcome").alias("__outcome"), F.col("new_path").alias("__new")).dropDuplicates(["path"])
    left = members.join(done, "path", "left").where(~F.coalesce(F.col("__outcome").isin("removed", "storage_deduplicated"), F.lit(False)))
    left = left.withColumn("path", F.when(F.col("__outcome") == "renamed", F.col("__new")).otherwise(F.col("path"))).select(*members.columns)
    big = left.groupBy(*group).agg(F.count("*").alias("__n")).where("__n >= 2").select(*group)
    return left.join(big, group, "left_semi")


def in_drive_scope(members: DataFrame, group: list[str], drive: str | None, references: list[str] = ()) -> DataFrame:
    """Members of the groups that have one under the drive's root or under a reference root; all without a drive."""
    if drive is None:
        return members
    inside = F.lit(False)
    for root in [drive, *references]:
        inside = inside | under_root(F.col("path"), F.lit(root))
    return members.join(members.where(inside).select(*group).distinct(), group, "left_semi")


def restore_plan(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Manifest rows (original, archived, size) with outcome: archived_missing, original_exists or restore. Nothing is overwritten."""
    there = existing.select("path").distinct()
    found = manifest.join(there.select(F.col("path").alias("archived"), F.lit(True).alias("__a")), "archived", "left").join(there.select(F.col("path").alias("original"), F.lit(True).alias("__o")), "original", "left")
    outcome = F.when(F.col("__a").isNull(), "archived_missing").when(F.col("__o"), "original_exists").otherwise("restore")
    return found.withColumn("outcome", outcome).drop("__a", "__o")


def restore_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("size").cast("bigint").alias("bytes"))
