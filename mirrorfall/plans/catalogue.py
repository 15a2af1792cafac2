"""The query catalogue: every operator over the driver's tables, with the same query as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, exclusions, globs, labels, paths, scoring
from ..operators import cache, corpora, filters, groups, history, keepers, metrics, similarity
from ..sources import mounts
from .fixtures import AS_OF, FPS, GROUPS, INV, fingerprints, inventory, member_rows, table
from .scan import ScanConfig, report_counters, scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _joined(files: str = "files") -> F.Column:
    return F.array_join(files, "|").alias("files")


# Groups


@query("size_classes", f"WITH {INV} SELECT size, count(*)::BIGINT AS n_files FROM inv GROUP BY size HAVING count(*) >= 2")
def _(spark, d):
    return groups.size_classes(inventory(spark, d))


@query("exact_groups", f"WITH {GROUPS} SELECT size, content_hash, n_files, files FROM grp")
def _(spark, d):
    return groups.exact_groups(inventory(spark, d)).select("size", "content_hash", "n_files", _joined())


@query("exact_members", f"WITH {GROUPS}, num AS (SELECT *, row_number() OVER (ORDER BY size DESC, files) AS group_no FROM grp) SELECT group_no::BIGINT AS group_no, m.size, m.path FROM num JOIN mem m USING (size, content_hash)")
def _(spark, d):
    return groups.members(groups.numbered(groups.exact_groups(inventory(spark, d)))).select("group_no", "size", "path")


@query("dedup_summary", f"WITH {GROUPS} SELECT count(*)::BIGINT AS groups, coalesce(sum(n_files), 0)::BIGINT AS files, coalesce(sum((n_files - 1) * size), 0)::BIGINT AS reclaim_bytes FROM grp")
def _(spark, d):
    return groups.summary(groups.exact_groups(inventory(spark, d))).select("groups", "files", "reclaim_bytes")


_TIERS = (
    INV
    + """, s0 AS (SELECT *, count(*) OVER (PARTITION BY size) AS n FROM inv), t0 AS (SELECT * FROM s0 WHERE n >= 2),
s1 AS (SELECT *, sha256(encode(content)[1:64]) AS t1 FROM t0), c1 AS (SELECT *, count(*) OVER (PARTITION BY size, t1) AS n1 FROM s1), t1_ AS (SELECT * FROM c1 WHERE n1 >= 2),
s2 AS (SELECT *, CASE WHEN size >= 1024 THEN sha256(encode(content)[1:128] || encode(content)[(size - 128) // 2 + 1:(size - 128) // 2 + 128] || encode(content)[size - 127:size]) END AS t2 FROM t1_),
c2 AS (SELECT *, count(*) OVER (PARTITION BY size, t1, t2) AS n2 FROM s2), t2_ AS (SELECT * FROM c2 WHERE n2 >= 2),
s3 AS (SELECT *, sha256(content) AS t3 FROM t2_), c3 AS (SELECT *, count(*) OVER (PARTITION BY size, t3) AS n3 FROM s3), t3_ AS (SELECT * FROM c3 WHERE n3 >= 2)"""
)


def _tiers(spark, d):
    inv = inventory(spark, d)
    return inv, groups.tiered(inv, tier1_bytes=64, floor=1024, window=128)


@query("tier_funnel", f"WITH {_TIERS} SELECT 'inventory' AS stage, count(*)::BIGINT AS files FROM inv UNION ALL SELECT 'size', count(*) FROM t0 UNION ALL SELECT 'head', count(*) FROM t1_ UNION ALL SELECT 'sampled', count(*) FROM t2_ UNION ALL SELECT 'full', count(*) FROM t3_")
def _(spark, d):
    return groups.funnel(*_tiers(spark, d))


@query(
    "tier_counters",
    f"""WITH {_TIERS} SELECT 'head' AS tier, count(*)::BIGINT AS files, coalesce(sum(least(size, 64)), 0)::BIGINT AS bytes_read, round(100.0::DOUBLE * (count(*) - (SELECT count(*) FROM t1_)) / nullif(count(*), 0), 4) AS culled_pct FROM t0
UNION ALL SELECT 'sampled', count(*), coalesce(sum(384), 0)::BIGINT, NULL FROM t1_ WHERE size >= 1024
UNION ALL SELECT 'full', count(*), coalesce(sum(size), 0)::BIGINT, round(100.0::DOUBLE * (count(*) - (SELECT count(*) FROM t3_)) / nullif(count(*), 0), 4) FROM t2_""",
)
def _(spark, d):
    inv, tiers = _tiers(spark, d)
    return groups.tier_counters(inv, tiers, tier1_bytes=64, window=128, floor=1024)


@query("optional_tier_prune", f"WITH {INV}, f AS (SELECT *, CASE WHEN volume IN ('src0', 'src3') THEN sha256(content) END AS fp FROM inv), c AS (SELECT *, count(*) OVER (PARTITION BY size, fp) AS n FROM f) SELECT path, size FROM c WHERE fp IS NULL OR n >= 2")
def _(spark, d):
    inv = inventory(spark, d).withColumn("fp", F.when(F.col("volume").isin("src0", "src3"), F.sha2("content", 256)))
    return groups.prune_optional(inv.drop("content"), ["size"], "fp").select("path", "size")


@query("candidate_bytes", f"WITH {INV}, c AS (SELECT size, count(*) AS n FROM inv GROUP BY size HAVING count(*) >= 2) SELECT coalesce(sum(size * n), 0)::BIGINT AS candidate_bytes FROM c")
def _(spark, d):
    return groups.candidate_bytes(inventory(spark, d))


@query("reclaim_ceiling", f"WITH {GROUPS}, c AS (SELECT coalesce(sum((n_files - 1) * size), 0)::BIGINT AS ceiling_bytes FROM grp) SELECT ceiling_bytes, CASE WHEN ceiling_bytes > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 100000.0::DOUBLE / ceiling_bytes)) ELSE 0.0::DOUBLE END AS efficiency FROM c")
def _(spark, d):
    return groups.reclaim_ceiling(groups.exact_groups(inventory(spark, d)), 100_000)


@query("inode_groups", f"WITH {INV} SELECT lang AS volume, file_ref, count(*)::BIGINT AS n_links, min(path) AS first_path FROM (SELECT *, split_part(path, '/', 3) AS lang FROM inv) GROUP BY lang, file_ref HAVING count(*) >= 2")
def _(spark, d):
    return groups.inode_groups(inventory(spark, d).withColumn("volume", F.split_part("path", F.lit("/"), F.lit(3)))).select("volume", "file_ref", "n_links", "first_path")


_IDENTITY = GROUPS + ", idg AS (SELECT size, content_hash, count(*)::BIGINT AS n_files, count(DISTINCT 'v:' || (doc_id // 400))::BIGINT AS unique_inodes, min(path) AS first_path FROM mem GROUP BY size, content_hash)"


def _identity(spark, d):
    inv = inventory(spark, d).withColumns({"volume": F.lit("v"), "file_ref": F.expr("doc_id div 400")})
    return groups.identity_groups(inv)


@query("inode_savings", f"WITH {_IDENTITY} SELECT first_path, n_files, unique_inodes, unique_inodes = 1 AS link_equivalent, (CASE WHEN unique_inodes = 1 THEN 0 ELSE (unique_inodes - 1) * size END)::BIGINT AS saved_bytes FROM idg")
def _(spark, d):
    g = _identity(spark, d)
    return g.select("first_path", "n_files", "unique_inodes", "link_equivalent", groups.savings(F.col("size"), F.col("n_files"), F.col("unique_inodes"), F.col("link_equivalent")).alias("saved_bytes"))


@query("largest_reclaim", f"WITH {_IDENTITY} SELECT max((unique_inodes - 1) * size)::BIGINT AS largest FROM idg WHERE unique_inodes > 1")
def _(spark, d):
    return _identity(spark, d).where(~F.col("link_equivalent")).agg(F.max((F.col("unique_inodes") - 1) * F.col("size")).cast("bigint").alias("largest"))


@query("top10_reclaim", f"WITH {GROUPS} SELECT row_number() OVER (ORDER BY (n_files - 1) * size DESC, content_hash)::BIGINT AS rank, content_hash, n_files, ((n_files - 1) * size)::BIGINT AS reclaim_bytes FROM grp ORDER BY reclaim_bytes DESC, content_hash LIMIT 10")
def _(spark, d):
    return groups.top_reclaim(groups.exact_groups(inventory(spark, d))).select("rank", "content_hash", "n_files", "reclaim_bytes")


_BUCKET = "CASE WHEN size < 10000 THEN '<10KB' WHEN size < 100000 THEN '<100KB' WHEN size < 1000000 THEN '<1MB' WHEN size < 10000000 THEN '<10MB' WHEN size < 100000000 THEN '<100MB' ELSE '>100MB' END"


@query("size_histogram", f"WITH {INV} SELECT {_BUCKET} AS bucket, count(*)::BIGINT AS n_files, sum(size)::BIGINT AS bytes FROM inv GROUP BY 1")
def _(spark, d):
    return groups.size_histogram(inventory(spark, d))


@query("size_signature", f"WITH {INV}, h AS (SELECT {_BUCKET} || '=' || count(*) AS x FROM inv GROUP BY {_BUCKET}) SELECT sha256(string_agg(x, ';' ORDER BY x)) AS signature FROM h")
def _(spark, d):
    return groups.size_signature(inventory(spark, d))


@query("treemap_weights", f"WITH {GROUPS}, w AS (SELECT content_hash, ((n_files - 1) * size)::BIGINT AS weight FROM grp) SELECT content_hash, weight, round(weight / (SELECT sum(weight) FROM w), 9) AS share FROM w WHERE weight > 0")
def _(spark, d):
    return groups.treemap_weights(groups.exact_groups(inventory(spark, d))).select("content_hash", "weight", F.round("share", 9).alias("share"))


@query("distinct_first", f"WITH {INV}, two AS (SELECT path, size, 0 AS root_no FROM inv UNION ALL SELECT path, size + 1, 1 FROM inv WHERE doc_id % 3 = 0 UNION ALL SELECT path || '.x', size, 1 FROM inv WHERE doc_id % 5 = 0) SELECT path, size FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY root_no) AS r FROM two) WHERE r = 1")
def _(spark, d):
    inv = inventory(spark, d).select("path", "size", "doc_id")
    two = inv.select("path", "size", F.lit(0).alias("root_no")).unionByName(inv.where("doc_id % 3 = 0").select("path", (F.col("size") + 1).alias("size"), F.lit(1).alias("root_no")))
    two = two.unionByName(inv.where("doc_id % 5 = 0").select(F.concat("path", F.lit(".x")).alias("path"), "size", F.lit(1).alias("root_no")))
    return groups.distinct_first(two, "path", ["root_no"]).select("path", "size")


# Filters and paths


@query("min_max_filter", f"WITH {INV} SELECT path, size FROM inv WHERE size >= 1000 AND size <= 5000")
def _(spark, d):
    return filters.size_range(inventory(spark, d), 1000, 5000).select("path", "size")


@query("include_exclude", f"WITH {INV} SELECT path FROM inv WHERE regexp_full_match(path, '.*/(en|de)/.*') AND NOT regexp_full_match(path, '.*doc[0-9]\\.txt') AND NOT regexp_full_match(path, '/src3/.*')")
def _(spark, d):
    return inventory(spark, d).where(globs.include_exclude(F.col("path"), ["*/{en,de}/*"], ["*doc[0-9].txt", "/src3/**"])).select("path")


def _planted(spark, d):
    """Paths with pieces that packs know, from doc_id."""
    piece = "CASE doc_id % 8 WHEN 0 THEN '/home/u/node_modules/x/' WHEN 1 THEN '/usr/lib/' WHEN 2 THEN '/home/u/.git/objects/ab/' WHEN 3 THEN '/home/u/Downloads/' WHEN 4 THEN '/home/u/Desktop/Draft/' WHEN 5 THEN '/home/u/.cache/pip/' WHEN 6 THEN '/tmp/' ELSE '/home/u/OneDrive/a/b/' END"
    name = "CASE doc_id % 5 WHEN 0 THEN concat('doc', doc_id, '.DLL') WHEN 1 THEN concat('report_final', doc_id, '.txt') WHEN 2 THEN concat('Copy of doc', doc_id, '.pdf') WHEN 3 THEN concat('doc (', doc_id % 7, ').txt') ELSE concat('x_draft', doc_id, '.so') END"
    return table(spark, d, "documents").select("doc_id", F.expr(f"concat({piece}, {name})").alias("path"), F.expr(f"{AS_OF} - (doc_id * 7919 % 4000) * 86400").alias("mtime_unix"))


_PLANTED = f"""planted AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '/home/u/node_modules/x/' WHEN 1 THEN '/usr/lib/' WHEN 2 THEN '/home/u/.git/objects/ab/' WHEN 3 THEN '/home/u/Downloads/' WHEN 4 THEN '/home/u/Desktop/Draft/' WHEN 5 THEN '/home/u/.cache/pip/' WHEN 6 THEN '/tmp/' ELSE '/home/u/OneDrive/a/b/' END ||
CASE doc_id % 5 WHEN 0 THEN 'doc' || doc_id || '.DLL' WHEN 1 THEN 'report_final' || doc_id || '.txt' WHEN 2 THEN 'Copy of doc' || doc_id || '.pdf' WHEN 3 THEN 'doc (' || (doc_id % 7) || ').txt' ELSE 'x_draft' || doc_id || '.so' END AS path,
({AS_OF} - (doc_id * 7919 % 4000) * 86400)::BIGINT AS mtime_unix FROM documents)"""


@query(
    "exclusion_reasons",
    f"""WITH {_PLANTED}, r AS (SELECT CASE WHEN regexp_full_match(path, '/home/u/Desktop/.*') THEN 'custom-pattern' WHEN path LIKE '%/node_modules/%' THEN 'pack-path:build-artefacts' WHEN path LIKE '%/.git/objects/%' THEN 'pack-path:vcs-internals' WHEN path LIKE '/usr/lib/%' THEN 'pack-path:os-system-trees'
WHEN path LIKE '%.pdf' THEN 'custom-extension' WHEN lower(path) LIKE '%.dll' OR path LIKE '%.so' THEN 'pack-extension:system-libraries' ELSE 'kept' END AS reason FROM planted) SELECT reason, count(*)::BIGINT AS files FROM r GROUP BY reason""",
)
def _(spark, d):
    packs = exclusions.select_packs(enable=["build-artefacts"])
    reason = exclusions.exclusion_reason(F.col("path"), packs, patterns=["/home/u/Desktop/**"], extensions=["PDF"])
    return _planted(spark, d).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("files"))


@query("exclusion_packs")
def _(spark, d):
    return exclusions.exclusion_packs(spark)


@query(
    "filter_counters",
    f"""WITH {INV}, r AS (SELECT size, CASE WHEN NOT (root IN ('/src0', '/src1', '/src2', '/src4')) THEN 'outside_roots' WHEN size < 500 THEN 'too_small' WHEN size > 8000 THEN 'too_large' WHEN path LIKE '%/fr/%' THEN 'glob' ELSE 'kept' END AS reason FROM inv)
SELECT reason, count(*)::BIGINT AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM r GROUP BY reason""",
)
def _(spark, d):
    reason = filters.drop_reason(roots=["/src0", "/src1/", "/src2", "/src4"], least=500, most=8000, exclude=["*/fr/*"], packs=["vcs-internals"])
    return filters.filter_counts(inventory(spark, d), reason)


_NAME = "regexp_extract(path, '([^/]*)$', 1)"


@query(
    "path_scalars",
    f"""WITH {_PLANTED} SELECT doc_id, {_NAME} AS name, lower(regexp_extract({_NAME}, '\\.([^.]*)$', 1)) AS ext, (length(path) - length(replace(path, '/', '')) + 1)::BIGINT AS depth, path LIKE '/usr/%' AS is_system, false AS is_share,
'subdirectory' AS scope, CASE WHEN path LIKE '/usr/%' THEN 'system' ELSE 'user-data' END AS kind, false AS is_root FROM planted""",
)
def _(spark, d):
    p = F.col("path")
    return _planted(spark, d).select("doc_id", paths.basename(p).alias("name"), paths.extension(p).alias("ext"), paths.depth(p).alias("depth"), paths.is_system_path(p).alias("is_system"), paths.is_network_share(p).alias("is_share"), paths.scope(F.array(p)).alias("scope"), paths.corpus_kind(F.array(p)).alias("kind"), paths.is_drive_root(p).alias("is_root"))


@query("url_scalars", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, length(url)::BIGINT AS bytes FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("name"), F.octet_length("url").cast("bigint").alias("bytes"))


_SCORE = f"""(CASE WHEN regexp_matches(lower(path), '/temp/|/tmp/|/cache/|/caches/|/node_modules/|/\\.cargo/|/\\.rustup/|/target/debug/|/target/release/|/__pycache__/|/\\.gradle/|/\\.npm/|/\\.yarn/|appdata/local/temp') THEN -50 ELSE 0 END
+ CASE WHEN lower(path) LIKE '%/desktop/%' THEN -10 ELSE 0 END + CASE WHEN lower(path) LIKE '%/downloads/%' THEN -8 ELSE 0 END + CASE WHEN lower(path) LIKE '%/onedrive/%' THEN 5 ELSE 0 END
+ least(greatest(length(path) - length(replace(path, '/', '')) - 2, 0), 10) + CASE WHEN regexp_matches(lower({_NAME}), '_final|-final| final\\.|\\.final\\.|final_') THEN 10 ELSE 0 END
+ CASE WHEN regexp_matches(lower({_NAME}), '_draft|-draft| draft\\.|\\.draft\\.|draft_|_wip|-wip|wip_|_old|-old|old_|_bak|\\.bak|\\.backup|_backup|-backup') THEN -10 ELSE 0 END + CASE WHEN lower({_NAME}) LIKE 'copy of %' THEN -20 ELSE 0 END
+ CASE WHEN regexp_matches({_NAME}, ' \\([0-9]+\\)') THEN greatest(-12, -3 * regexp_extract({_NAME}, ' \\(([0-9]+)\\)', 1)::BIGINT) ELSE 0 END
+ least(greatest(3.0::DOUBLE - (({AS_OF} - mtime_unix) / 86400.0::DOUBLE) / 60, 0), 3))"""


@query("keep_score", f"WITH {_PLANTED} SELECT doc_id, round({_SCORE}, 6)::DOUBLE AS score FROM planted")
def _(spark, d):
    return _planted(spark, d).select("doc_id", F.round(scoring.keep_score(F.col("path"), F.col("mtime_unix"), F.lit(AS_OF)), 6).alias("score"))


@query("text_sniff", "SELECT page_id, (length(left(html, 4096)) = 0 OR length(regexp_replace(left(html, 4096), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) * 10 >= length(left(html, 4096)) * 9) AS is_text FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", metrics.text_like(F.substring("html", 1, 4096)).alias("is_text"))


_HUMAN = "CASE WHEN x >= 1099511627776 THEN printf('%.2f', (x * 100 + 549755813888) // 1099511627776 / 100.0::DOUBLE) || ' TiB' WHEN x >= 1073741824 THEN printf('%.2f', (x * 100 + 536870912) // 1073741824 / 100.0::DOUBLE) || ' GiB' WHEN x >= 1048576 THEN printf('%.2f', (x * 100 + 524288) // 1048576 / 100.0::DOUBLE) || ' MiB' WHEN x >= 1024 THEN printf('%.2f', (x * 100 + 512) // 1024 / 100.0::DOUBLE) || ' KiB' ELSE x || ' B' END"


@query("human_sizes", f"WITH {INV}, s AS (SELECT path, 0 AS k, size AS x FROM inv UNION ALL SELECT path, 1, size * 1048576 FROM inv) SELECT path, k::BIGINT AS k, {_HUMAN} AS shown FROM s")
def _(spark, d):
    inv = inventory(spark, d)
    rows = inv.select("path", F.lit(0).cast("bigint").alias("k"), F.col("size").alias("x")).unionByName(inv.select("path", F.lit(1).cast("bigint").alias("k"), (F.col("size") * (1 << 20)).alias("x")))
    return rows.select("path", "k", paths.human_size(F.col("x")).alias("shown"))


# Keepers, references, actions

_KEEP_ORDER = {"first": "ordinal", "oldest": "mtime_unix, ordinal", "newest": "mtime_unix DESC, ordinal", "shortest": "strlen(path), ordinal", "longest": "strlen(path) DESC, ordinal"}


def _keeper_query(strategy: str) -> None:
    sql = f"WITH {GROUPS} SELECT first_value(path) OVER w AS keeper_path, path, row_number() OVER w = 1 AS is_keeper FROM mem WINDOW w AS (PARTITION BY size, content_hash ORDER BY {_KEEP_ORDER[strategy]})"

    @query(f"keeper_{strategy}", sql)
    def _(spark, d):
        rows = member_rows(spark, d).withColumn("is_reference", F.lit(False))
        return keepers.pick_keeper(rows, ["size", "content_hash"], strategy).select("keeper_path", "path", "is_keeper")


for _strategy in _KEEP_ORDER:
    _keeper_query(_strategy)


@query("keeper_smart", f"WITH {GROUPS}, s AS (SELECT *, round((2 - 0 + least(greatest(3.0::DOUBLE - (({AS_OF} - mtime_unix) / 86400.0::DOUBLE) / 60, 0), 3))::DOUBLE, 4) AS sc FROM mem) SELECT first_value(path) OVER w AS keeper_path, path FROM s WINDOW w AS (PARTITION BY size, content_hash ORDER BY sc DESC, mtime_unix DESC, ordinal)")
def _(spark, d):
    rows = member_rows(spark, d).withColumn("is_reference", F.lit(False))
    return keepers.pick_keeper(rows, ["size", "content_hash"], "smart", as_of=AS_OF).select("keeper_path", "path")


_REFS = "(root IN ('/src1', '/src2', '/src3', '/src4', '/src5') OR path LIKE '/src6/en/%')"
_REF_ROOTS = ["/src1", "/src2/", "/src3", "/src4", "/src5", "/src6/en"]


@query("reference_members", f"WITH {INV} SELECT path FROM inv WHERE {_REFS}")
def _(spark, d):
    return keepers.mark_references(inventory(spark, d), _REF_ROOTS).where("is_reference").select("path")


@query("reference_only_drop", f"WITH {GROUPS}, r AS (SELECT *, {_REFS} AS is_reference FROM mem) SELECT path, is_reference FROM r WHERE (size, content_hash) IN (SELECT (size, content_hash) FROM r GROUP BY size, content_hash HAVING bool_or(NOT is_reference))")
def _(spark, d):
    rows = keepers.mark_references(member_rows(spark, d), _REF_ROOTS)
    return keepers.drop_reference_only(rows, ["size", "content_hash"]).select("path", "is_reference")


@query("keeper_in_reference", f"WITH {GROUPS}, r AS (SELECT *, {_REFS} AS ref FROM mem), a AS (SELECT *, bool_or(ref) OVER (PARTITION BY size, content_hash) AS has_ref FROM r) SELECT first_value(path) OVER (PARTITION BY size, content_hash ORDER BY ref DESC, ordinal) AS keeper_path, path FROM a WHERE has_ref")
def _(spark, d):
    rows = keepers.mark_references(member_rows(spark, d), _REF_ROOTS)
    return keepers.pick_keeper(rows, ["size", "content_hash"], "in-reference").select("keeper_path", "path")


def _plan(spark, d):
    rows = keepers.mark_references(member_rows(spark, d), ["/src1", "/src2"])
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.join(labels, "doc_id", "left").withColumns({
        "decode_warning": F.coalesce(F.col("toxic") == 1, F.lit(False)),
        "current_size": F.when(F.col("doc_id") % 11 == 3, F.col("size") + 1).otherwise(F.col("size")),
        "placeholder": F.when(F.col("doc_id") % 13 == 5, "recall-on-open").otherwise("none"),
        "file_ref": F.when(F.col("doc_id") % 17 == 6, F.lit(None)).otherwise(F.expr("doc_id div 300")),
        "volume": F.lit("v"),
    })
    return keepers.plan_actions(keepers.pick_keeper(rows, ["size", "content_hash"], "oldest"), ["size", "content_hash"], "remove")


_PLAN = (
    GROUPS
    + """, lab AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
pr AS (SELECT m.*, root IN ('/src1', '/src2') AS is_reference, coalesce(toxic = 1, false) AS warned, CASE WHEN m.doc_id % 11 = 3 THEN size + 1 ELSE size END AS now_size, m.doc_id % 13 = 5 AS held,
CASE WHEN m.doc_id % 17 = 6 THEN NULL ELSE m.doc_id // 300 END AS ref FROM mem m LEFT JOIN lab ON lab.doc_id = m.doc_id),
kp AS (SELECT *, row_number() OVER w = 1 AS is_keeper, first_value(path) OVER w AS keeper_path, first_value(ref) OVER w AS keeper_ref FROM pr WINDOW w AS (PARTITION BY size, content_hash ORDER BY is_reference DESC, mtime_unix, ordinal)),
plan AS (SELECT path, keeper_path, 'remove' AS action, size AS size_bytes, CASE WHEN is_keeper THEN 'left_alone' WHEN is_reference THEN 'skipped_reference' WHEN now_size <> size THEN 'skipped_invalidated' WHEN warned THEN 'skipped_decode_warning' WHEN held THEN 'refused_placeholder'
WHEN ref = keeper_ref THEN 'refused_keeper_identity' WHEN ref IS NULL THEN 'refused_keeper_unresolvable' ELSE 'dry_run_no_change' END AS outcome FROM kp)"""
)


@query("action_plan", f"WITH {_PLAN} SELECT path, keeper_path, action, outcome, size_bytes FROM plan")
def _(spark, d):
    return _plan(spark, d).select("path", "keeper_path", "action", "outcome", "size_bytes")


@query("action_outcomes", f"WITH {_PLAN} SELECT outcome, count(*)::BIGINT AS n, sum(size_bytes)::BIGINT AS bytes FROM plan GROUP BY outcome")
def _(spark, d):
    return keepers.outcome_counts(_plan(spark, d))


@query("locked_sums", f"WITH {_PLAN} SELECT 'bytes_removed' AS key, sum(size_bytes)::BIGINT AS bytes FROM plan WHERE outcome = 'dry_run_no_change' HAVING count(*) > 0")
def _(spark, d):
    return keepers.locked_sums(_plan(spark, d))


@query("bulk_plan", f"WITH {GROUPS} SELECT first_path AS keeper, n_files - 1 AS n_targets FROM grp WHERE size > 0")
def _(spark, d):
    return keepers.bulk_plan(groups.exact_groups(inventory(spark, d))).select("keeper", F.size("targets").cast("bigint").alias("n_targets"))


# Similarity


@query("hamming_pairs", f"WITH {FPS} SELECT a.id AS a, b.id AS b, bit_count(xor(a.fp, b.fp))::BIGINT AS distance FROM fps a JOIN fps b ON a.id < b.id AND bit_count(xor(a.fp, b.fp)) <= 5")
def _(spark, d):
    return similarity.hamming_pairs(fingerprints(spark, d), 5)


_COMPONENTS = (
    FPS
    + """, e AS (SELECT a.id AS a, b.id AS b FROM fps a JOIN fps b ON a.id <> b.id AND bit_count(xor(a.fp, b.fp)) <= 5), ids AS (SELECT DISTINCT a AS id FROM e),
r1 AS (SELECT id, least(id, min(b)) AS l FROM ids JOIN e ON e.a = ids.id GROUP BY id), r2 AS (SELECT e.a AS id, least(min(x.l), any_value(y.l)) AS l FROM e JOIN r1 x ON x.id = e.b JOIN r1 y ON y.id = e.a GROUP BY e.a),
r3 AS (SELECT e.a AS id, least(min(x.l), any_value(y.l)) AS l FROM e JOIN r2 x ON x.id = e.b JOIN r2 y ON y.id = e.a GROUP BY e.a), comp AS (SELECT id, l AS component FROM r3)"""
)


def _clusters(spark, d):
    rows = fingerprints(spark, d)
    return rows, similarity.components(similarity.hamming_links(rows, 5))


@query("hamming_components", f"WITH {_COMPONENTS} SELECT id, component FROM comp")
def _(spark, d):
    return _clusters(spark, d)[1]


@query("cohesion_filter", f"WITH {_COMPONENTS}, m AS (SELECT component, fp FROM comp JOIN fps USING (id)), d AS (SELECT a.component, max(bit_count(xor(a.fp, b.fp)))::BIGINT AS diameter FROM m a JOIN m b USING (component) GROUP BY a.component) SELECT component, (SELECT count(*) FROM comp c WHERE c.component = d.component)::BIGINT AS n, diameter FROM d WHERE diameter <= 10")
def _(spark, d):
    rows, clusters = _clusters(spark, d)
    return similarity.cohesive(clusters, rows, 5).select("component", "n", "diameter")


@query("cluster_representatives", f"WITH {_COMPONENTS} SELECT component, count(*)::BIGINT AS n_files, max(size)::BIGINT AS size, arg_min(fp, path) AS fp, min(path) AS first_path FROM comp JOIN fps USING (id) GROUP BY component")
def _(spark, d):
    rows, clusters = _clusters(spark, d)
    return similarity.representatives(clusters, rows)



@query(
    "array_hamming_pairs",
    """WITH v AS (SELECT vec_id AS id, [(round(embedding[i * 8 + 1] * 1000)::INT & 1023) FOR i IN range(8)] AS fp FROM embeddings), r AS (SELECT * FROM v UNION ALL SELECT id + 1000000, [xor(x, 1) FOR x IN fp] FROM v WHERE id % 7 = 0),
p AS (SELECT a.id AS a, b.id AS b, list_sum([bit_count(xor(a.fp[k], b.fp[k])) FOR k IN range(1, 9)])::DOUBLE / 8 AS distance FROM r a JOIN r b ON a.id < b.id) SELECT a, b, distance FROM p WHERE distance <= 1""",
)
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    chunk = lambda i: F.round(F.get("embedding", i * 8) * 1000).cast("int").bitwiseAND(F.lit(1023))
    rows = vectors.select(F.col("vec_id").alias("id"), F.array(*[chunk(F.lit(i)) for i in range(8)]).alias("fp"))
    twins = rows.where("id % 7 = 0").select((F.col("id") + 1_000_000).alias("id"), F.transform("fp", lambda x: x.bitwiseXOR(F.lit(1))).alias("fp"))
    return similarity.array_hamming_pairs(rows.unionByName(twins), 1)


@query("tau_auto", "SELECT n, CASE WHEN n < 100 THEN 5 ELSE greatest(3, 5 - (length((n // 100)::VARCHAR) - 1)) END::BIGINT AS tau FROM (VALUES (0::BIGINT), (1), (50), (99), (100), (999), (1000), (9999), (10000), (100000), (1000000)) t(n)")
def _(spark, d):
    values = spark.createDataFrame([(n,) for n in (0, 1, 50, 99, 100, 999, 1000, 9999, 10000, 100000, 1000000)], "n bigint")
    return values.select("n", bits.tau_for_n(F.col("n")).alias("tau"))


@query("union_groups", f"WITH {GROUPS}, {_COMPONENTS} SELECT 'byte-identical' AS similarity_kind, count(*)::BIGINT AS n_groups FROM grp UNION ALL SELECT 'perceptual-image', count(DISTINCT component) FROM comp")
def _(spark, d):
    exact = groups.exact_groups(inventory(spark, d)).select("size", "n_files")
    rows, clusters = _clusters(spark, d)
    alike = similarity.representatives(clusters, rows).select("size", "n_files")
    return groups.similarity_breakdown(groups.union_kinds(byte_identical=exact, perceptual_image=alike))


# Cache and incremental work


def _cached(spark, d):
    inv = inventory(spark, d).withColumns({"hash_algo": F.lit("sha256"), "usn": F.col("doc_id") * 2, "file_ref": F.col("doc_id")})
    old = inv.where("doc_id % 5 <> 0").select(
        "volume", "file_ref", "hash_algo",
        F.when(F.col("doc_id") % 7 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(F.col("doc_id") % 9 == 2, F.col("mtime_ticks") - 1).otherwise(F.col("mtime_ticks")).alias("mtime_ticks"),
        F.when(F.col("doc_id") % 11 == 3, F.col("usn") - 1).otherwise(F.col("usn")).alias("usn"),
        F.sha2(F.substring("content", 1, 16), 256).alias("t1"), F.lit(None).cast("string").alias("t2"), F.when(F.col("doc_id") % 2 == 0, F.sha2("content", 256)).alias("t3"),
    )
    return inv, old


_CACHED = (
    INV
    + """, cur AS (SELECT volume, doc_id AS file_ref, size, mtime_ticks, doc_id * 2 AS usn, content, doc_id FROM inv),
old AS (SELECT volume, file_ref, CASE WHEN doc_id % 7 = 1 THEN size + 1 ELSE size END AS size, CASE WHEN doc_id % 9 = 2 THEN mtime_ticks - 1 ELSE mtime_ticks END AS mtime_ticks, CASE WHEN doc_id % 11 = 3 THEN usn - 1 ELSE usn END AS usn,
sha256(left(content, 16)) AS t1, CASE WHEN doc_id % 2 = 0 THEN sha256(content) END AS t3 FROM cur WHERE doc_id % 5 <> 0),
look AS (SELECT c.file_ref, CASE WHEN o.file_ref IS NULL THEN 'no-row' WHEN c.size <> o.size THEN 'drift-size' WHEN c.mtime_ticks <> o.mtime_ticks THEN 'drift-mtime' WHEN c.usn <> o.usn THEN 'drift-usn' ELSE 'hit' END AS outcome, o.t3 FROM cur c LEFT JOIN old o USING (volume, file_ref))"""
)


@query("cache_drift", f"WITH {_CACHED} SELECT file_ref, outcome, CASE WHEN outcome = 'hit' THEN t3 END AS t3 FROM look")
def _(spark, d):
    return cache.cache_lookup(*_cached(spark, d)).select("file_ref", "outcome", "t3")


@query("cache_outcomes", f"WITH {_CACHED} SELECT outcome, count(*)::BIGINT AS n FROM look GROUP BY outcome")
def _(spark, d):
    return cache.outcome_counts(cache.cache_lookup(*_cached(spark, d)))


@query(
    "cache_upsert",
    f"""WITH {_CACHED}, fresh AS (SELECT volume, file_ref, size, mtime_ticks, usn, sha256(left(content, 16)) AS t1 FROM cur WHERE doc_id % 3 = 0)
SELECT file_ref, CASE WHEN f.size IS NOT NULL THEN f.size ELSE o.size END AS size, CASE WHEN f.size IS NULL THEN o.t1 ELSE f.t1 END AS t1, CASE WHEN f.size IS NULL THEN o.t3 WHEN f.size = o.size AND f.mtime_ticks = o.mtime_ticks AND f.usn = o.usn THEN o.t3 END AS t3 FROM old o FULL JOIN fresh f USING (volume, file_ref)""",
)
def _(spark, d):
    inv, old = _cached(spark, d)
    none = F.lit(None).cast("string")
    fresh = inv.where("doc_id % 3 = 0").select("volume", "file_ref", "hash_algo", "size", "mtime_ticks", "usn", F.sha2(F.substring("content", 1, 16), 256).alias("t1"), none.alias("t2"), none.alias("t3"))
    return cache.cache_upsert(old, fresh).select("file_ref", "size", "t1", "t3")


@query("resume_anti", f"WITH {GROUPS} SELECT content_hash FROM grp WHERE content_hash NOT IN (SELECT sha256(content) FROM inv WHERE doc_id % 3 = 0)")
def _(spark, d):
    inv = inventory(spark, d)
    done = inv.where("doc_id % 3 = 0").select(F.sha2("content", 256).alias("content_hash"))
    return cache.resume(groups.exact_groups(inv).select("content_hash"), done, ["content_hash"])


@query(
    "cdc_merge",
    """WITH snap AS (SELECT o_orderkey AS file_ref, o_totalprice AS value FROM orders WHERE o_orderkey % 2 = 0), ch AS (SELECT user_id AS file_ref, value, event_id AS usn, event_type = 'error' OR event_id % 4 = 0 AS deleted FROM events),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_ref ORDER BY usn DESC) AS r FROM ch) WHERE r = 1)
SELECT file_ref, value FROM snap WHERE file_ref NOT IN (SELECT file_ref FROM last) UNION ALL SELECT file_ref, value FROM last WHERE NOT deleted""",
)
def _(spark, d):
    snap = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("file_ref"), F.col("o_totalprice").alias("value"))
    changes = table(spark, d, "events").select(F.col("user_id").alias("file_ref"), "value", F.col("event_id").alias("usn"), ((F.col("event_type") == "error") | (F.col("event_id") % 4 == 0)).alias("deleted"))
    return cache.merge_changes(snap, changes)


@query(
    "parent_paths",
    """WITH RECURSIVE rec AS (SELECT 0::BIGINT AS file_ref, NULL::BIGINT AS parent_ref, 'root' AS name UNION ALL SELECT 1 + r_regionkey, 0, r_name FROM region UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, n_name FROM nation UNION ALL SELECT 1000 + s_suppkey, 100 + s_nationkey, s_name FROM supplier),
walk AS (SELECT file_ref, name AS path, 0::BIGINT AS hops FROM rec WHERE parent_ref IS NULL UNION ALL SELECT r.file_ref, w.path || '/' || r.name, w.hops + 1 FROM rec r JOIN walk w ON r.parent_ref = w.file_ref) SELECT file_ref, path, hops, 'ok' AS status FROM walk""",
)
def _(spark, d):
    row = lambda df, key, parent, name: df.select(key.cast("bigint").alias("file_ref"), parent.cast("bigint").alias("parent_ref"), name.alias("name"))
    top = spark.sql("SELECT CAST(0 AS BIGINT) AS file_ref, CAST(NULL AS BIGINT) AS parent_ref, 'root' AS name")
    c = F.col
    rows = top.unionByName(row(table(spark, d, "region"), c("r_regionkey") + 1, F.lit(0), c("r_name")))
    rows = rows.unionByName(row(table(spark, d, "nation"), c("n_nationkey") + 100, c("n_regionkey") + 1, c("n_name")))
    rows = rows.unionByName(row(table(spark, d, "supplier"), c("s_suppkey") + 1000, c("s_nationkey") + 100, c("s_name")))
    return cache.parent_paths(rows)


# History, metrics, corpora

_HIST = "hist AS (SELECT o_orderkey AS scan_id, o_orderdate AS started_at, CASE o_orderstatus WHEN 'O' THEN 'pending' ELSE 'done' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 5 DAY END AS last_attempt, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS completed_at FROM orders)"


def _history(spark, d):
    day = lambda n: F.col("o_orderdate") + F.expr(f"INTERVAL {n} DAY")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("scan_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("state"),
        F.when(F.col("o_orderkey") % 3 == 0, day(5)).alias("last_attempt"), F.when(F.col("o_orderkey") % 2 == 0, day(1)).alias("completed_at"),
    )


@query("history_latest", f"WITH {_HIST} SELECT scan_id FROM hist ORDER BY started_at DESC, scan_id DESC LIMIT 25")
def _(spark, d):
    return history.newest_first(_history(spark, d), 25).select("scan_id")


@query("history_pending", f"WITH {_HIST} SELECT scan_id FROM hist WHERE state = 'pending' AND coalesce(last_attempt, completed_at, started_at) <= TIMESTAMP '1996-06-01'")
def _(spark, d):
    return history.pending_older_than(_history(spark, d), F.expr("TIMESTAMP_NTZ '1996-06-01'")).select("scan_id")


@query("history_prune", f"WITH {_HIST} SELECT scan_id FROM hist WHERE started_at >= TIMESTAMP '1998-01-01' - INTERVAL 365 DAY")
def _(spark, d):
    return history.prune(_history(spark, d), F.expr("TIMESTAMP_NTZ '1998-01-01'"), 365 * 86400).select("scan_id")


@query("pending_actions", "SELECT event_type AS key, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS bytes FROM events WHERE ts >= TIMESTAMP '2024-02-05' - INTERVAL 30 DAY GROUP BY event_type")
def _(spark, d):
    rows = table(spark, d, "events").select("ts", F.col("event_type").alias("key"), F.round(F.col("value") * 100).cast("bigint").alias("bytes"))
    return history.pending_sums(rows, F.expr("TIMESTAMP_NTZ '2024-02-05'"))


@query(
    "throughput",
    """WITH s AS (SELECT user_id % 16 AS drive, epoch_us(ts) AS t, CAST(round(value * 100) AS BIGINT) AS bytes, event_id FROM events), w AS (SELECT *, sum(bytes) OVER (PARTITION BY drive ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)::BIGINT AS window_bytes FROM s)
SELECT event_id, window_bytes, max(window_bytes) OVER (PARTITION BY drive ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS peak_bytes FROM w""",
)
def _(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 16).alias("drive"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.round(F.col("value") * 100).cast("bigint").alias("bytes"), "event_id")
    return history.throughput(rows, 3600).select("event_id", "window_bytes", "peak_bytes")


@query("root_fingerprint", f"WITH {INV} SELECT root, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes, max(mtime_ticks)::BIGINT AS latest FROM inv GROUP BY root")
def _(spark, d):
    return history.root_fingerprint(inventory(spark, d))


@query(
    "fingerprint_match",
    f"""WITH {INV}, a AS (SELECT root, count(*)::BIGINT AS c, sum(size)::BIGINT AS s, max(mtime_ticks) AS m FROM inv GROUP BY root), b AS (SELECT root, count(*)::BIGINT AS c, sum(size)::BIGINT AS s, max(mtime_ticks) AS m FROM inv WHERE doc_id % 97 <> 5 GROUP BY root)
SELECT root, abs(a.c - b.c) <= greatest(1, greatest(a.c, b.c) // 200) AND abs(a.s - b.s) <= greatest(1024, greatest(a.s, b.s) // 200) AND a.m = b.m AS same FROM a JOIN b USING (root)""",
)
def _(spark, d):
    inv = inventory(spark, d)
    a, b = history.root_fingerprint(inv).alias("a"), history.root_fingerprint(inv.where("doc_id % 97 <> 5")).alias("b")
    c = F.col
    return a.join(b, "root").select("root", filters.tolerance_match(c("a.files"), c("b.files"), c("a.bytes"), c("b.bytes"), c("a.latest"), c("b.latest")).alias("same"))


@query(
    "predicates",
    f"""WITH {_PLANTED}, o AS (SELECT bool_or(length(path) - length(replace(path, '/', '')) + 1 >= 15) AS a, bool_or(path LIKE '%/.git/%') AS b, bool_or(mtime_unix < 1262304000) AS c, bool_or(path LIKE '%/Downloads/%' AND mtime_unix < {AS_OF} - 157680000) AS e FROM planted)
SELECT unnest(['abyss-walker', 'git-repo-detected', 'time-capsule', 'screenshot-graveyard', 'download-archaeology', 'polyglot-paths', 'format-fanatic', 'picky-eater', 'verify-veteran', 'recursive', 'shadercache-hoarder']) AS predicate, unnest([a, b, c, false, e, false, false, true, false, false, false]) AS granted FROM o""",
)
def _(spark, d):
    return metrics.predicates(_planted(spark, d), AS_OF, pattern_edits=12, verifications=3)


@query(
    "esoterics",
    f"WITH {_IDENTITY}, n AS (SELECT 'doc' || (doc_id % 50) || '.txt' AS name, content_hash FROM mem), v AS (SELECT name FROM n GROUP BY name HAVING count(DISTINCT content_hash) >= 2) SELECT (SELECT nullif(coalesce(max(n_files) FILTER (size = 0), 0), 0) FROM idg)::BIGINT AS largest_empty_group, (SELECT nullif(coalesce(max(n_files) FILTER (unique_inodes = 1), 0), 0) FROM idg)::BIGINT AS largest_link_group, nullif((SELECT count(*) FROM v), 0)::BIGINT AS names_with_variants",
)
def _(spark, d):
    rows = member_rows(spark, d).select(F.expr("concat('/x/doc', doc_id % 50, '.txt')").alias("path"), "content_hash")
    return metrics.esoterics(_identity(spark, d), rows)


@query("share_roots", "SELECT count(DISTINCT lower(regexp_extract(replace(replace(url, 'https://', 'smb://'), 'http://', 'nfs://'), '^(?:smb|nfs)://([^/?#]+)', 1)))::BIGINT AS share_roots FROM pages")
def _(spark, d):
    url = F.regexp_replace(F.regexp_replace("url", "^https://", "smb://"), "^http://", "nfs://")
    return metrics.share_roots(table(spark, d, "pages").select(F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1).alias("path")))


@query("ram_buckets", "SELECT p_partkey, CASE WHEN p_size >= 32 THEN 32 WHEN p_size >= 16 THEN 16 WHEN p_size >= 8 THEN 8 ELSE 4 END::BIGINT AS bucket FROM part WHERE p_size < 64")
def _(spark, d):
    return table(spark, d, "part").where("p_size < 64").select("p_partkey", metrics.ram_bucket(F.col("p_size")).alias("bucket"))


@query("cpu_brackets", "SELECT p_partkey, CASE WHEN p_type ILIKE '%brass%' THEN 'b' WHEN p_type ILIKE '%steel%' THEN 's' WHEN p_type ILIKE 'promo%' THEN 'p' ELSE 'unknown' END AS bracket FROM part")
def _(spark, d):
    brands = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_type"), F.lit("(R) CPU")).alias("brand"))
    return metrics.first_bracket(brands, [("b", "brass"), ("s", "steel"), ("p", "^promo")]).select("p_partkey", "bracket")


@query("badge_wall", "WITH g AS (SELECT 'b' || (c_nationkey % 6) || CASE WHEN c_custkey % 3 = 0 THEN '#' || (2020 + c_custkey % 4) ELSE '' END AS grant_id FROM customer WHERE c_nationkey % 6 < 4), k AS (SELECT regexp_replace(grant_id, '#[0-9]{4}$', '') AS id, list_sort(list_distinct(list(CASE WHEN grant_id LIKE '%#%' THEN right(grant_id, 4)::BIGINT END) FILTER (grant_id LIKE '%#%'))) AS ys FROM g GROUP BY 1), c AS (SELECT 'b' || i AS id, i = 2 AS locked, 10 - i AS o FROM range(6) t(i)) SELECT id, array_to_string(ys, ',') AS years, ys IS NOT NULL AND NOT locked AS granted, row_number() OVER (ORDER BY CASE WHEN ys IS NOT NULL AND NOT locked THEN 0 WHEN NOT locked THEN 1 ELSE 2 END, o, id)::BIGINT AS position FROM c LEFT JOIN k USING (id)")
def _(spark, d):
    customer = table(spark, d, "customer").where("c_nationkey % 6 < 4")
    grants = customer.select(F.expr("concat('b', c_nationkey % 6, case when c_custkey % 3 = 0 then concat('#', 2020 + c_custkey % 4) else '' end)").alias("grant_id"))
    catalog = spark.range(6).select(F.expr("concat('b', id)").alias("id"), (F.col("id") == 2).alias("locked"), (10 - F.col("id")).alias("display_order"))
    return metrics.badge_wall(catalog, grants)


@query("slugs", "SELECT c_custkey, trim(left(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-'), 26)) AS slug FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", metrics.derive_slug(F.col("c_name")).alias("slug"))


@query("corpus_dupsets", "WITH p AS (SELECT i AS index, [4096, 1048576, 268435456][((i // 3) % 3 + 1)::INT]::BIGINT AS size, CASE WHEN (i // 3) % 4 = 0 THEN (i // 3) * 3 ELSE i END AS content_id FROM range(1000) t(i)) SELECT size, content_id::BIGINT AS content_id, count(*)::BIGINT AS n, string_agg(index::VARCHAR, ',' ORDER BY index) AS members FROM p GROUP BY size, content_id HAVING count(*) >= 2")
def _(spark, d):
    return corpora.dupsets(corpora.corpus_plan(spark, 1000))


@query("cluster_audit", "SELECT * FROM (VALUES (12::BIGINT, 3::BIGINT, 0::BIGINT, 2::BIGINT), (24, 3, 1, 1)) t(content_id, members, missing, distinct_hashes)")
def _(spark, d):
    plan = corpora.corpus_plan(spark, 120)
    hashes = plan.where("index <> 25").select("index", F.when(F.col("index") == 13, "odd").otherwise(F.concat(F.lit("h"), "content_id")).alias("hash"))
    return corpora.audit(plan, hashes)


@query("hash_diff", "SELECT index, h0, CASE WHEN index % 40 = 0 THEN 'x' ELSE h0 END AS h1, CASE WHEN index % 60 <> 0 THEN h0 END AS h2 FROM (SELECT i AS index, sha256(i::VARCHAR) AS h0 FROM range(200) t(i)) WHERE index % 40 = 0 OR index % 60 = 0")
def _(spark, d):
    base = spark.range(200).select(F.col("id").alias("index"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    other = base.withColumn("hash", F.when(F.col("index") % 40 == 0, "x").otherwise(F.col("hash")))
    return corpora.diff_hashes(base, other, base.where("index % 60 <> 0"))


@query("snapshot_diff", f"WITH {INV} SELECT path, CASE WHEN doc_id % 10 = 1 THEN 'removed' WHEN doc_id % 10 = 2 THEN 'added' ELSE 'changed' END AS change FROM inv WHERE doc_id % 10 IN (1, 2, 3)")
def _(spark, d):
    inv = inventory(spark, d).select("path", "doc_id", F.sha2("content", 256).alias("digest"))
    after = inv.where("doc_id % 10 <> 1").withColumn("digest", F.when(F.col("doc_id") % 10 == 3, "x").otherwise(F.col("digest")))
    return corpora.snapshot_diff(inv.where("doc_id % 10 <> 2"), after)


@query("leaf_explode", "WITH f AS (SELECT p_partkey AS index, (p_size * 100000)::BIGINT AS size FROM part) SELECT index, o AS offset, least(1048576, size - o)::BIGINT AS length FROM (SELECT index, size, unnest(range(0, size, 1048576)) AS o FROM f)")
def _(spark, d):
    return corpora.leaves(table(spark, d, "part").select(F.col("p_partkey").alias("index"), (F.col("p_size") * 100000).cast("bigint").alias("size")))


@query("merkle_root", "WITH l AS (SELECT n_nationkey AS p, sha256('\\x00'::BLOB || encode(n_name)) AS h FROM nation), " + ", ".join(f"m{k + 1} AS (SELECT p // 2 AS p, CASE WHEN count(*) = 2 THEN sha256('\\x01'::BLOB || unhex(min_by(h, p)) || unhex(max_by(h, p))) ELSE any_value(h) END AS h FROM {'l' if not k else f'm{k}'} GROUP BY p // 2)" for k in range(5)) + " SELECT h AS root FROM m5")
def _(spark, d):
    return corpora.merkle_root(table(spark, d, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("leaf")))


@query("result_digest", f"WITH {GROUPS} SELECT sha256('dupsets|' || count(*) || '|' || string_agg(n_files || ':' || files, ';' ORDER BY n_files || ':' || files)) AS digest FROM grp")
def _(spark, d):
    return corpora.result_digest(groups.exact_groups(inventory(spark, d)).select(F.col("n_files").alias("n"), F.array_join("files", "|").alias("members")))


@query("pseudo_sample", "WITH v AS (SELECT i AS id, ('0x' || substr(sha256('sample|seed|' || i), 1, 12))::BIGINT % 1000 AS value FROM range(264) t(i)) SELECT min(id)::BIGINT AS k, value FROM v GROUP BY value ORDER BY k LIMIT 50")
def _(spark, d):
    return corpora.sample(spark, "seed", 1000, 50)


@query("longest_mount", f"WITH {INV}, m(mountpoint, fstype) AS (VALUES ('/', 'ext4'), ('/src1', 'xfs'), ('/src1/en', 'nfs'), ('/src12', 'zfs')) SELECT path, arg_max(mountpoint, length(mountpoint)) AS mountpoint, arg_max(fstype, length(mountpoint)) AS fstype FROM inv JOIN m ON mountpoint = '/' OR starts_with(path, mountpoint || '/') GROUP BY path")
def _(spark, d):
    points = spark.createDataFrame([(0, "/", "ext4"), (1, "/src1/", "xfs"), (2, "/src1/en", "nfs"), (3, "/src12", "zfs")], "ordinal int, mountpoint string, fstype string")
    out = mounts.longest_mount(inventory(spark, d).select("path"), points)
    return out.withColumn("mountpoint", F.when(F.col("mountpoint") == "/src1/", "/src1").otherwise(F.col("mountpoint")))


@query("placeholders", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'recall-on-open' WHEN event_id % 7 = 1 THEN 'recall-on-data-access' WHEN event_id % 7 = 2 THEN 'reparse-dedup' WHEN event_id % 7 = 3 THEN 'other-reparse' ELSE 'none' END AS placeholder, event_id % 7 IN (0, 1, 3) AS no_read, event_id % 7 < 4 AS no_action FROM events")
def _(spark, d):
    case = F.col("event_id") % 7
    attributes = F.when(case == 0, bits.RECALL_ON_OPEN).when(case == 1, bits.RECALL_ON_DATA_ACCESS).when(case.isin(2, 3), bits.REPARSE_POINT).otherwise(32)
    rows = table(spark, d, "events").select("event_id", bits.classify_placeholder(attributes.cast("bigint"), F.when(case == 2, bits.DEDUP_TAG).otherwise(7).cast("bigint")).alias("placeholder"))
    return rows.select("event_id", "placeholder", bits.blocks_read(F.col("placeholder")).alias("no_read"), bits.blocks_action(F.col("placeholder")).alias("no_action"))


# Whole scans


@query("scan_report", f"WITH {GROUPS} SELECT (SELECT count(*) FROM inv WHERE size >= 300)::BIGINT AS inventory_files, count(*)::BIGINT AS groups, coalesce(sum(n_files), 0)::BIGINT AS files_in_groups, coalesce(sum((n_files - 1) * size), 0)::BIGINT AS reclaim_bytes FROM grp WHERE size >= 300")
def _(spark, d):
    return report_counters(scan(inventory(spark, d), ScanConfig(min_size=300)))


# Labels, classes, outcomes


@query(
    "number_labels",
    """WITH n AS (SELECT o_orderkey, o_orderkey * [1, 10007, 1000003][(o_orderkey % 3 + 1)::INT] AS x, o_orderkey * 977 % 9000000 AS ms FROM orders)
SELECT o_orderkey, CASE WHEN x >= 1000000000 THEN printf('%.2f', (x + 5000000) // 10000000 / 100.0::DOUBLE) || 'B' WHEN x >= 1000000 THEN printf('%.2f', (x + 5000) // 10000 / 100.0::DOUBLE) || 'M' WHEN x >= 1000 THEN printf('%.1f', (x + 50) // 100 / 10.0::DOUBLE) || 'k' ELSE x::VARCHAR END AS compact, format('{:,}', x) AS thousands,
CASE WHEN ms < 60000 THEN printf('%.1f', (ms + 50) // 100 / 10.0::DOUBLE) || 's' WHEN ms < 3600000 THEN (ms // 60000) || 'm ' || lpad((ms % 60000 // 1000)::VARCHAR, 2, '0') || 's' ELSE (ms // 3600000) || 'h ' || lpad((ms % 3600000 // 60000)::VARCHAR, 2, '0') || 'm' END AS wall, strftime(make_timestamp(x * 1000000 % 4000000000000000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM n""",
)
def _(spark, d):
    key, x = F.col("o_orderkey"), F.col("x")
    rows = table(spark, d, "orders").select("o_orderkey", (key * F.element_at(F.array(F.lit(1), F.lit(10007), F.lit(1000003)), (key % 3 + 1).cast("int"))).alias("x"))
    return rows.select("o_orderkey", labels.compact(x).alias("compact"), labels.thousands(x).alias("thousands"), labels.wallclock(key * 977 % 9_000_000).alias("wall"), labels.iso_utc(x % 4_000_000_000).alias("iso"))


@query(
    "event_classes",
    """SELECT event_id, ['truncated', 'truncated', 'corrupt_header', 'mid_stream_corrupt', 'unknown'][(event_id % 5 + 1)::INT] AS decode, ['access_denied', 'cross_device', 'cross_device', 'other'][(event_id % 4 + 1)::INT] AS failure,
CASE event_id % 20 WHEN 17 THEN 'NVMe-Gen4' WHEN 11 THEN 'SATA-SSD' WHEN 3 THEN 'SATA-SSD' WHEN 16 THEN 'mixed' WHEN 7 THEN CASE WHEN event_id % 3 = 2 THEN 'USB-HDD' ELSE 'USB-SSD' END END AS disk, (CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 64 ELSE 0 END)::BIGINT AS features,
['blake3', 'river5', 'river5', NULL][(event_id % 4 + 1)::INT] AS algo, ['unavailable', 'unavailable', 'text', 'text', 'system-handler', 'hex'][(event_id % 6 + 1)::INT] AS preview FROM events""",
)
def _(spark, d):
    e = F.col("event_id")
    at = lambda *values: F.element_at(F.array(*map(F.lit, values)), (e % len(values) + 1).cast("int"))
    return table(spark, d, "events").select(
        "event_id", labels.decode_error_kind(at("unexpected EOF", "Truncated header", "bad STREAMINFO", "frame CRC", "odd")).alias("decode"), labels.archive_failure(at("permission-denied", "crosses-devices", "storage-full", "not-found")).alias("failure"),
        labels.disk_class(e % 20, at(0, 1, 7200)).alias("disk"), labels.feature_bitmap({"cache": e % 2 == 0, "reference_roots": e % 3 == 0}).alias("features"), labels.hash_name(at("blake3", "river5", "ddh128", "md5")).alias("algo"),
        labels.preview_mode(e % 6 != 0, e % 6 != 1, e % 6 == 2, e % 6 == 3, e % 6 == 4).alias("preview"),
    )


@query("nickname_faults", "SELECT c_custkey, [NULL, 'bad_character', 'empty', 'too_long', 'reserved', NULL][(c_custkey % 6 + 1)::INT] AS fault FROM customer")
def _(spark, d):
    names = F.array(F.translate("c_name", "#", " "), F.col("c_name"), F.lit(""), F.repeat(F.lit("x"), 33), F.lit("user-0123abCD"), F.lit("user-0123abCDe"))
    return table(spark, d, "customer").select("c_custkey", labels.nickname_fault(F.element_at(names, (F.col("c_custkey") % 6 + 1).cast("int"))).alias("fault"))


@query("drive_groups", f"WITH {INV} SELECT CASE doc_id % 3 WHEN 0 THEN 'D:' WHEN 1 THEN '\\\\srv\\' || source ELSE source END AS drive, count(*)::BIGINT AS paths FROM (SELECT *, volume AS source FROM inv) GROUP BY 1".replace("\\\\srv\\", chr(92) * 2 + "srv" + chr(92)))
def _(spark, d):
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(r"\\?\d:"), "path")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(r"\\srv"), "path")).otherwise(F.col("path"))
    return inventory(spark, d).groupBy(labels.drive_id(made).alias("drive")).agg(F.count("*").alias("paths"))


@query("same_roots", "SELECT c_custkey, c_custkey % 4 IN (0, 1) AS same FROM customer")
def _(spark, d):
    other = F.element_at(F.array(F.array(F.lit("/b"), F.lit("/a")), F.array(F.lit("/a"), F.lit("/b/")), F.array(F.lit("/a")), F.array(F.lit("/a"), F.lit("/B"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", labels.same_roots(F.array(F.lit("/a/"), F.lit("/b")), other).alias("same"))


@query("cache_identity", f"WITH {INV} SELECT path, CASE WHEN doc_id % 5 = 0 THEN '_unknown_volume' ELSE volume END AS volume, CASE WHEN doc_id % 3 = 0 OR file_ref = 0 THEN ('0x' || substr(sha256(path), 1, 15))::BIGINT ELSE file_ref END AS file_ref FROM inv")
def _(spark, d):
    rows = inventory(spark, d).select("path", F.when(F.col("doc_id") % 5 != 0, F.col("volume")).alias("volume"), F.when(F.col("doc_id") % 3 != 0, F.col("file_ref")).alias("file_ref"))
    return cache.with_identity(rows)


@query("applied_outcomes", f"WITH {GROUPS} SELECT size, CASE WHEN doc_id % 5 = 1 THEN path || '.bak' ELSE path END AS path FROM mem WHERE doc_id % 5 <> 0 QUALIFY count(*) OVER (PARTITION BY size, content_hash) >= 2")
def _(spark, d):
    rows = member_rows(spark, d)
    outcome = F.when(F.col("doc_id") % 5 == 0, "removed").when(F.col("doc_id") % 5 == 1, "renamed")
    done = rows.select("path", outcome.alias("outcome"), F.concat("path", F.lit(".bak")).alias("new_path")).where("outcome is not null")
    return keepers.apply_outcomes(rows, ["size", "content_hash"], done).select("size", "path")


@query("drive_scope", f"WITH {GROUPS} SELECT path FROM mem SEMI JOIN (SELECT size, content_hash FROM mem WHERE path LIKE '/src1/%' OR path LIKE '/src3/en/%') x USING (size, content_hash)")
def _(spark, d):
    return keepers.in_drive_scope(member_rows(spark, d), ["size", "content_hash"], "/src1", ["/src3/en"]).select("path")


@query("keeper_swap", f"WITH {GROUPS}, l AS (SELECT size, content_hash, list(path ORDER BY path) AS l FROM mem GROUP BY ALL) SELECT size, content_hash, array_to_string(l[len(l):] || l[2:len(l) - 1] || l[1:1], '|') AS files FROM l")
def _(spark, d):
    grp = groups.exact_groups(inventory(spark, d)).withColumn("keeper", F.element_at("files", -1))
    return keepers.keeper_first(grp).select("size", "content_hash", _joined())


_CLASSES = "c AS (SELECT p_partkey, p_size * 100000::BIGINT AS fs, 100 + p_partkey % 50 AS fc, p_partkey % 7 AS s, p_partkey % 3 AS b, p_partkey % 4 AS g FROM part), st AS (SELECT *, (s + b * greatest(g - 1, 0))::BIGINT AS dups FROM c)"


def _classes(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 100000).cast("bigint").alias("file_size"), (100 + k % 50).alias("file_count"), (k % 7).alias("pairs"), (k % 3).alias("big_sets"), (k % 4).alias("big_size"))
    return corpora.class_stats(rows)


@query("class_stats", f"WITH {_CLASSES} SELECT p_partkey, dups, (fc - dups)::BIGINT AS originals, (fc * ((fs + 1048575) // 1048576))::BIGINT AS leaves, (dups * fs)::BIGINT AS dup_bytes, (fc * fs)::BIGINT AS total_bytes FROM st")
def _(spark, d):
    return _classes(spark, d).select("p_partkey", "dups", "originals", "leaves", "dup_bytes", "total_bytes")


@query("reclaimable_fraction", f"WITH {_CLASSES} SELECT sum(dups * fs)::DOUBLE / sum(fc * fs)::DOUBLE AS fraction FROM st")
def _(spark, d):
    return corpora.reclaimable_fraction(_classes(spark, d))


@query("largest_dupset", f"WITH {GROUPS} SELECT coalesce(max(n_files), 0)::BIGINT AS largest FROM grp")
def _(spark, d):
    return corpora.largest_dupset(groups.exact_groups(inventory(spark, d)), "n_files")


@query("restore_summary", f"WITH {INV} SELECT CASE WHEN doc_id % 7 = 0 THEN 'archived_missing' WHEN doc_id % 5 = 0 THEN 'original_exists' ELSE 'restore' END AS outcome, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes FROM inv GROUP BY 1")
def _(spark, d):
    manifest = inventory(spark, d).select("doc_id", F.col("path").alias("original"), F.concat(F.lit("/archive/"), "doc_id").alias("archived"), "size")
    existing = manifest.where("doc_id % 7 != 0").select(F.col("archived").alias("path")).unionByName(manifest.where("doc_id % 5 = 0").select(F.col("original").alias("path")))
    return keepers.restore_summary(keepers.restore_plan(manifest.drop("doc_id"), existing))


@query("grant_counts", "SELECT (SELECT count(DISTINCT c_nationkey % 6) FROM customer WHERE c_nationkey % 6 < 4)::BIGINT AS granted, 6::BIGINT AS total")
def _(spark, d):
    grants = table(spark, d, "customer").where("c_nationkey % 6 < 4").select(F.expr("concat('b', c_nationkey % 6, case when c_custkey % 3 = 0 then '#2024' else '' end)").alias("grant_id"))
    return metrics.grant_counts(spark.range(6).select(F.expr("concat('b', id)").alias("id")), grants)


@query("resume_tiers", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'fresh' WHEN 1 THEN 'fresh' WHEN 2 THEN 'marker' WHEN 3 THEN 'warm' WHEN 4 THEN 'inventory-only' ELSE 'full' END AS tier FROM customer")
def _(spark, d):
    k = F.col("c_custkey") % 6
    return table(spark, d, "customer").select("c_custkey", history.resume_tier(k != 0, k != 2, k != 1, k != 3, F.when(k == 5, 9).otherwise(0)).alias("tier"))


@query("slug_faults", "SELECT c_custkey, ['too_short', 'too_long', 'bad_character', 'edge_hyphen', 'double_hyphen', 'reserved', NULL][(c_custkey % 7 + 1)::INT] AS fault FROM customer")
def _(spark, d):
    slugs = F.array(*map(F.lit, ("ab", "a" * 31, "Abc", "-abc", "a--b", "admin", "a-b-1")))
    return table(spark, d, "customer").select("c_custkey", metrics.valid_slug(F.element_at(slugs, (F.col("c_custkey") % 7 + 1).cast("int"))).alias("fault"))
