"""Path scalars. Paths are strings with / or \\ between segments; sizes and lengths are in bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ticks of 100 ns from 1601 to 1970.
TICKS_TO_EPOCH = 116_444_736_000_000_000

#: Path parts that mark system trees.
SYSTEM_PREFIXES = ("/etc/", "/usr/", "/bin/", "/var/lib/")
SYSTEM_PREFIXES_WINDOWS = ("c:\\windows\\", "c:\\program files\\", "c:\\program files (x86)\\", "c:\\programdata\\")
#: Own marker files.
MARKER = ".mirrorfall"


def display(path: Column) -> Column:
    r"""Without the verbatim prefix: `\\?\UNC\server` as `\\server`, `\\?\C:` as `C:`."""
    return F.regexp_replace(F.regexp_replace(path, r"^\\\\\?\\UNC\\", r"\\\\"), r"^\\\\\?\\", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension: NULL without a dot or for a dotfile, empty for a trailing dot."""
    name = basename(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)))


def normalised_extension(ext: Column) -> Column:
    return F.lower(F.regexp_replace(ext, r"^\.+", ""))


def depth(path: Column) -> Column:
    """Number of path components; the root counts as one."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda x: (x != "") & (x != "."))
    return (F.size(parts) + F.when(path.startswith("/"), 1).otherwise(0)).cast("bigint")


def has_component(path: Column, name: str, ignore_case: bool = False) -> Column:
    parts = F.split(F.lower(path) if ignore_case else path, r"[/\\]")
    return F.array_contains(parts, name.lower() if ignore_case else name)


def under_root(path: Column, root: Column) -> Column:
    """Whether root is path or a whole-segment prefix of it."""
    bare = F.regexp_replace(root, r"(?<=.)/+$", "")
    return (path == bare) | F.startswith(path, F.when(bare == "/", F.lit("/")).otherwise(F.concat(bare, F.lit("/"))))


def is_system_path(path: Column) -> Column:
    lower = F.lower(display(path))
    out = F.lit(False)
    for prefix in SYSTEM_PREFIXES + SYSTEM_PREFIXES_WINDOWS:
        out = out | F.startswith(lower, F.lit(prefix))
    return out


def is_own_footprint(path: Column) -> Column:
    name = basename(path)
    return name.startswith(f"{MARKER}-") | name.endswith(MARKER) | name.endswith(f"{MARKER}-clone-tmp")


def is_drive_root(path: Column) -> Column:
    return path.rlike(r"^/$|^.:\\$|^\\\\\?\\..\\$")


def share_root(path: Column) -> Column:
    r"""Authority of a UNC path or an smb, nfs or cifs URL, else NULL."""
    unc = F.regexp_extract(path, r"^\\\\(?:\?\\UNC\\)?([^\\?.][^\\]*\\[^\\]+)", 1)
    url = F.regexp_extract(path, r"^(?i:smb|nfs|cifs)://([^/]+)", 1)
    return F.lower(F.coalesce(F.nullif(unc, F.lit("")), F.nullif(url, F.lit(""))))


def is_network_share(path: Column) -> Column:
    return path.rlike(r"^\\\\[^?.]|^\\\\\?\\UNC\\|^(?i:smb|nfs|cifs)://")


def scope(roots: Column) -> Column:
    """selection, whole-volume or subdirectory, from an array of roots."""
    return F.when(F.size(roots) > 1, "selection").when(is_drive_root(F.get(roots, F.lit(0))), "whole-volume").otherwise("subdirectory")


def corpus_kind(roots: Column) -> Column:
    system = r"\\windows\\|\\windows$|/system/|^/system|\\program files|^/usr/|^/bin/|^/sbin/"
    return F.when(F.exists(roots, lambda r: F.lower(r).rlike(system)), "system").otherwise("user-data")


def looks_like_screenshot(name: Column) -> Column:
    return F.lower(name).rlike(r"^(screenshot[ \-_]|screen shot |img_|img[0-9])")


def ticks_from_unix(seconds: Column) -> Column:
    return (seconds * 10_000_000 + TICKS_TO_EPOCH).cast("bigint")


def unix_from_ticks(ticks: Column) -> Column:
    """Seconds since 1970; NULL for 0, which means unknown."""
    return F.when(ticks != 0, F.floor((ticks - TICKS_TO_EPOCH) / 10_000_000)).cast("bigint")


def human_size(size: Column) -> Column:
    """Binary units with two decimals."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(size >= 1024**power, F.concat(F.format_string("%.2f", size / 1024**power), F.lit(f" {unit}"))).otherwise(out)
    return out


def parse_size(text: str) -> int:
    """`10`, `4K`, `1.5 MiB` as bytes; ValueError for anything else or an overflow of 64 bits."""
    import re

    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([KMGT]?)(?:i?B)?\s*", text, re.IGNORECASE)
    if not found:
        raise ValueError(f"not a size: {text!r}")
    out = int(float(found[1]) * 1024 ** " KMGT".index(found[2].upper() or " "))
    if out >= 1 << 64:
        raise ValueError(f"too large: {text!r}")
    return out
