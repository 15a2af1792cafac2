"""Keeper score: how likely a path is the copy to keep. Every needle list is a fixed value."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import display

TRANSIENT = ("/temp/", "/tmp/", "/cache/", "/caches/", "/node_modules/", "/.cargo/", "/.rustup/", "/target/debug/", "/target/release/", "/__pycache__/", "/.gradle/", "/.npm/", "/.yarn/", "appdata/local/temp")
CLOUD = ("/onedrive/", "/dropbox/", "/google drive/")
FINAL = ("_final", "-final", " final.", ".final.", "final_")
DRAFT = ("_draft", "-draft", " draft.", ".draft.", "draft_", "_wip", "-wip", "wip_", "_old", "-old", "old_", "_bak", ".bak", ".bak.", ".backup", "_backup", "-backup")


def _holds(text: Column, needles: tuple[str, ...]) -> Column:
    return text.rlike("|".join(map(re.escape, needles)))


def keep_score(path: Column, mtime_unix: Column, as_of: Column) -> Column:
    """Sum of the location, depth, name and recency components, as a double; `as_of` is the time in Unix seconds."""
    flat = F.lower(F.regexp_replace(display(path), r"\\", "/"))
    name = F.regexp_extract(flat, r"([^/]*)$", 1)
    # The last " (" counts, and only if nothing but digits stands before the next ")".
    number = F.regexp_extract(name, r"^.* \(([0-9]+)\)", 1)
    last = F.regexp_extract(name, r"^.* \(([^)]*)\)", 1)
    days = (as_of - mtime_unix) / 86400
    parts = [
        F.when(_holds(flat, ("$recycle.bin", "/recycler/")), -100),
        F.when(_holds(flat, TRANSIENT), -50),
        F.when(flat.contains("/desktop/"), -10),
        F.when(flat.contains("/downloads/"), -8),
        F.when(_holds(flat, CLOUD), 5),
        F.least(F.greatest(F.regexp_count(flat, F.lit("/")) - 2, F.lit(0)), F.lit(10)),
        F.when(_holds(name, FINAL), 10),
        F.when(_holds(name, DRAFT), -10),
        F.when(name.startswith("copy of ") | name.startswith("copy-of-"), -20),
        F.when(name.contains(" - copy"), -15),
        F.when((number != "") & (number == last), F.greatest(F.lit(-12.0), -3.0 * number.cast("double"))),
        F.when(mtime_unix <= as_of, F.least(F.greatest(3.0 - days / 60, F.lit(0.0)), F.lit(3.0))),
    ]
    total = F.lit(0.0)
    for part in parts:
        total = total + F.coalesce(part.cast("double"), F.lit(0.0))
    return total


def tie_tolerance(best: Column) -> Column:
    return F.greatest(F.abs(best) * 1e-6, F.lit(1e-4))
