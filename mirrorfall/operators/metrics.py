"""Run-shape metrics, achievement predicates, catalogs, machine profiles, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import basename, depth, has_component, looks_like_screenshot, share_root

#: Unicode scripts that are told apart in paths, by their Java names.
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Devanagari", "Bengali", "Tamil", "Thai", "Georgian", "Hangul", "Hiragana", "Katakana", "Han")
EPOCH_2010 = 1_262_304_000
#: RAM buckets in GB.
RAM_BUCKETS = (4, 8, 16, 32, 64, 128, 256, 512, 1024)


def script_count(text: Column) -> Column:
    out = F.lit(0)
    for name in SCRIPTS:
        out = out + text.rlike(rf"\p{{Is{name}}}").cast("int")
    return out


def predicates(inventory: DataFrame, as_of: int, own_name: str = "mirrorfall", pattern_edits: int = 0, verifications: int = 0, own_files: tuple[str, str] = ("__spark_entry__.py", "plans/catalogue.py")) -> DataFrame:
    """One row a predicate: predicate, granted. inventory has path and mtime_unix; NULL where there is nothing to judge."""
    path, mtime = F.col("path"), F.col("mtime_unix")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    hits = F.count_if(has_component(path, "shadercache", ignore_case=True))
    columns = {
        "abyss-walker": any_(depth(path) >= 15),
        "git-repo-detected": any_(has_component(path, ".git")),
        "time-capsule": any_(mtime < EPOCH_2010),
        "screenshot-graveyard": F.count_if(looks_like_screenshot(basename(path))) >= 100,
        "download-archaeology": any_(has_component(path, "downloads", ignore_case=True) & (mtime < as_of - 5 * 365 * 86400)),
        "polyglot-paths": any_(script_count(path) >= 3),
        "format-fanatic": F.lit(False),
        "picky-eater": F.lit(pattern_edits >= 10),
        "verify-veteran": F.lit(verifications >= 10),
        "recursive": any_(has_component(path, own_name)) | (any_(path.endswith(own_files[0])) & any_(path.endswith(own_files[1]))),
        "shadercache-hoarder": F.when(F.count("*") > 0, hits * 2 > F.count("*")),
    }
    one = inventory.agg(*[c.alias(n) for n, c in columns.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("predicate"), F.col(f"`{n}`").alias("granted")) for n in columns])).alias("x")).select("x.*")


def esoterics(groups: DataFrame, members: DataFrame) -> DataFrame:
    """One row: largest group of empty files, largest group of links, names with two contents and more; 0 as NULL."""
    none = lambda c: F.nullif(F.coalesce(c, F.lit(0)).cast("bigint"), F.lit(0).cast("bigint"))
    sizes = groups.agg(none(F.max(F.when(F.col("size") == 0, F.col("n_files")))).alias("largest_empty_group"), none(F.max(F.when(F.col("link_equivalent"), F.col("n_files")))).alias("largest_link_group"))
    names = members.groupBy(basename(F.col("path")).alias("name")).agg(F.count_distinct("content_hash").alias("n")).where("n >= 2").agg(none(F.count("*")).alias("names_with_variants"))
    return sizes.crossJoin(names)  # one row each


def share_roots(paths: DataFrame) -> DataFrame:
    return paths.agg(F.count_distinct(share_root(F.col("path"))).alias("share_roots"))


def ram_bucket(gb: Column) -> Column:
    out = F.lit(RAM_BUCKETS[0])
    for size in RAM_BUCKETS:
        out = F.when(gb >= size, size).otherwise(out)
    return out.cast("bigint")


def clean_brand(brand: Column) -> Column:
    """Without trademark signs, the words CPU and Processor, and repeated blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(brand, r"(?i)\((r|tm)\)|®|™|\bcpu\b|\bprocessor\b", " "), r"\s+", " "))


def first_bracket(brands: DataFrame, brackets: list[tuple[str, str]]) -> DataFrame:
    """Adds bracket: the first of the ordered (bracket, regex) that matches the cleaned brand, else unknown."""
    out = F.lit("unknown")
    for name, pattern in reversed(brackets):
        out = F.when(clean_brand(F.col("brand")).rlike(f"(?i){pattern}"), name).otherwise(out)
    return brands.withColumn("bracket", out)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 45, "D").otherwise("F")


def disk_profile(ratio: Column) -> Column:
    return F.when(ratio >= 4, "much-faster").when(ratio >= 1.5, "faster").when(ratio >= 0.5, "similar").otherwise("slower")


def grant_base(grant: Column) -> Column:
    """`base#YEAR` without its year; another form is the whole id."""
    return F.when(grant.rlike(r"^[^#]+#\d{4}$"), F.regexp_extract(grant, r"^([^#]+)#", 1)).otherwise(grant)


def grant_year(grant: Column) -> Column:
    return F.when(grant.rlike(r"^[^#]+#\d{4}$"), F.regexp_extract(grant, r"#(\d{4})$", 1).cast("bigint"))


def badge_wall(catalog: DataFrame, grants: DataFrame) -> DataFrame:
    """Catalog (id, locked, display_order) with years, granted and position: granted, others, locked."""
    by = grants.groupBy(grant_base(F.col("grant_id")).alias("id")).agg(F.sort_array(F.collect_set(grant_year(F.col("grant_id")))).alias("years"))
    out = catalog.join(by.withColumn("__any", F.lit(True)), "id", "left").withColumn("granted", F.coalesce("__any", F.lit(False)) & ~F.col("locked"))
    bucket = F.when(F.col("granted"), 0).when(~F.col("locked"), 1).otherwise(2)
    out = out.withColumn("position", F.row_number().over(Window.orderBy(bucket, "display_order", "id")).cast("bigint"))
    return out.select("id", F.array_join("years", ",").alias("years"), "granted", "position")


def grant_counts(catalog: DataFrame, grants: DataFrame) -> DataFrame:
    """granted, total: how many of the catalog's ids have a grant, of any year, and how many there are."""
    held = grants.select(grant_base(F.col("grant_id")).alias("id"), F.lit(True).alias("__held")).distinct()
    return catalog.select("id").distinct().join(held, "id", "left").agg(F.count("__held").alias("granted"), F.count("*").alias("total"))


def valid_slug(slug: Column, reserved: tuple[str, ...] = ("admin", "api", "www")) -> Column:
    """NULL if the slug can be used, else the first rule that it breaks."""
    return (
        F.when(F.length(slug) < 3, "too_short")
        .when(F.length(slug) > 30, "too_long")
        .when(~slug.rlike(r"^[a-z0-9-]+$"), "bad_character")
        .when(slug.rlike(r"^-|-$"), "edge_hyphen")
        .when(slug.contains("--"), "double_hyphen")
        .when(slug.isin(*reserved), "reserved")
    )


def derive_slug(name: Column, attempt: Column | None = None) -> Column:
    base = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    base = F.substring(base, 1, 26)
    return base if attempt is None else F.when(attempt > 0, F.concat(base, F.lit("-"), attempt.cast("string"))).otherwise(base)


def text_like(head: Column) -> Column:
    """Whether a text's head is empty, or nine tenths printable."""
    return (F.length(head) == 0) | (F.regexp_count(head, F.lit(r"[^\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")) * 10 >= F.length(head) * 9)


def recommendations(probe: DataFrame) -> DataFrame:
    """Adds advice: the sorted texts of the rules that a probe row (files_per_s_thread, disk_mb_s, ram_gb, is_hdd) meets."""
    rules = F.array(
        F.when(F.col("files_per_s_thread") < 500, "few files a second: check the scanner's exclusions"),
        F.when(F.col("disk_mb_s") < 100, "slow disk: lower the number of reading threads"),
        F.when(F.col("is_hdd"), "rotating disk: read in physical order"),
        F.when(F.col("ram_gb") < 8, "little memory: keep the cache on disk"),
    )
    return probe.withColumn("advice", F.array_compact(rules))
