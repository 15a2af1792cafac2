"""Labels for people, and classes of errors, disks, features and previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hash names by their tags, older tags included.
HASH_TAGS = {"blake3": "blake3", "river5": "river5", "ddh128": "river5"}
#: Bits of the features that a scan used; bit 2 stays unused.
FEATURE_BITS = {"cache": 1, "format_aware": 2, "follow_links": 8, "allow_system_paths": 16, "allow_recall_on_read": 32, "reference_roots": 64, "include_glob": 128, "exclude_glob": 256}
#: Disk classes by the number of the bus.
BUS_CLASSES = {17: "NVMe-Gen4", 11: "SATA-SSD", 3: "SATA-SSD", 7: "USB-SSD", 16: "mixed"}


def wallclock(ms: Column) -> Column:
    """`4.2s`, `6m 12s` or `1h 08m`; tenths are rounded half up."""
    part = lambda unit, within: F.lpad(F.floor(F.pmod(ms, F.lit(within)) / unit).cast("string"), 2, "0")
    whole = lambda unit: F.floor(ms / unit).cast("string")
    return (
        F.when(ms < 60_000, F.concat(F.format_string("%.1f", ms / 1000), F.lit("s")))
        .when(ms < 3_600_000, F.concat(whole(60_000), F.lit("m "), part(1000, 60_000), F.lit("s")))
        .otherwise(F.concat(whole(3_600_000), F.lit("h "), part(60_000, 3_600_000), F.lit("m")))
    )


def compact(n: Column) -> Column:
    """`999`, `1.2k`, `3.45M`, `6.78B`; rounded half up."""
    return (
        F.when(n >= 1_000_000_000, F.concat(F.format_string("%.2f", n / 1e9), F.lit("B")))
        .when(n >= 1_000_000, F.concat(F.format_string("%.2f", n / 1e6), F.lit("M")))
        .when(n >= 1000, F.concat(F.format_string("%.1f", n / 1e3), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def iso_utc(seconds: Column) -> Column:
    """Unix seconds as `2024-01-31T08:00:00Z`, whatever the session's time zone."""
    at = F.expr("TIMESTAMP_NTZ '1970-01-01'") + F.make_dt_interval(secs=seconds)
    return F.concat(F.translate(at.cast("string"), " ", "T"), F.lit("Z"))


def category_label(category: Column) -> Column:
    """`lifetime-reclaimed` as `Lifetime reclaimed`; other categories get a capital in each word."""
    words = F.transform(F.split(category, "[-_]"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2))))
    return F.when(category == "lifetime-reclaimed", "Lifetime reclaimed").otherwise(F.array_join(words, " "))


def nickname_fault(name: Column, most: int = 32) -> Column:
    """NULL if the name can be used, else empty, too_long, bad_character or reserved, the first that applies."""
    return (
        F.when(F.length(name) < 1, "empty")
        .when(F.length(name) > most, "too_long")
        .when(~name.rlike(r"\A[A-Za-z0-9 _.'-]*\z"), "bad_character")
        .when(name.rlike(r"\Auser-[0-9A-Fa-f]{8}\z"), "reserved")
    )


def decode_error_kind(detail: Column) -> Column:
    lower = F.lower(detail)
    return F.when(lower.rlike("eof|truncat"), "truncated").when(lower.rlike("header|streaminfo"), "corrupt_header").when(lower.rlike("frame|crc"), "mid_stream_corrupt").otherwise("unknown")


def archive_failure(kind: Column) -> Column:
    return F.when(kind == "permission-denied", "access_denied").when(kind.isin("crosses-devices", "storage-full"), "cross_device").otherwise("other")


def disk_class(bus: Column, rotation: Column) -> Column:
    """Class by bus, refined on USB by the rotation rate (1: none, 0x401 to 0xFFFE: turns a minute); NULL for an unknown bus."""
    base = F.lit(None).cast("string")
    for number, name in BUS_CLASSES.items():
        base = F.when(bus == number, name).otherwise(base)
    return F.when((bus == 7) & rotation.between(0x401, 0xFFFE), "USB-HDD").otherwise(base)


def feature_bitmap(flags: dict[str, Column]) -> Column:
    out = F.lit(0).cast("bigint")
    for name, flag in flags.items():
        out = out.bitwiseOR(F.when(flag, F.lit(FEATURE_BITS[name])).otherwise(F.lit(0)).cast("bigint"))
    return out


def hash_name(tag: Column) -> Column:
    out = F.lit(None).cast("string")
    for known, name in HASH_TAGS.items():
        out = F.when(tag == known, name).otherwise(out)
    return out


def preview_mode(exists: Column, is_file: Column, text_extension: Column, text_like: Column, has_handler: Column) -> Column:
    return F.when(~exists | ~is_file, "unavailable").when(text_extension | text_like, "text").when(has_handler, "system-handler").otherwise("hex")


def drive_id(path: Column) -> Column:
    r"""`\\server\share`, `D:`, or the first component of another path."""
    bare = F.regexp_replace(path, r"^\\\\\?\\", "")
    unc = F.regexp_extract(bare, r"^\\\\([^\\/]+[\\/][^\\/]+)", 1)
    letter = F.regexp_extract(bare, r"^([A-Za-z]):", 1)
    first = F.regexp_extract(bare, r"^/?([^/\\]*)", 1)
    return F.when(unc != "", F.concat(F.lit("\\\\"), F.translate(unc, "/", "\\"))).when(letter != "", F.concat(F.upper(letter), F.lit(":"))).otherwise(first)


def same_roots(a: Column, b: Column) -> Column:
    """Whether two arrays of roots are equal but for their order and trailing separators."""
    bare = lambda x: F.array_sort(F.transform(x, lambda r: F.regexp_replace(r, r"(?<=.)[/\\]+$", "")))
    return bare(a) == bare(b)


def threshold(argument: str, auto: int) -> int:
    """`auto` or a number of bits."""
    if argument.lower() == "auto":
        return auto
    if not (argument.isascii() and argument.isdigit()):
        raise ValueError(f"expected a number of bits or auto: {argument!r}")
    return int(argument)
