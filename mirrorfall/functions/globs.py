"""Glob patterns as regular expressions, in two dialects: `*` crosses separators, or stays within a segment."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str, literal_separator: bool = False) -> str:
    """The pattern as an anchored regex; ** crosses segments in both dialects, {a,b} and [x-y] work as usual."""
    any_, one = ("[^/]*", "[^/]") if literal_separator else (".*", ".")
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("/**", i) and i + 3 == len(pattern):
            out.append("/.*")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end + 1
            continue
        if c == "{":
            depth += 1
        elif c == "}" and depth:
            depth -= 1
        out.append({"*": any_, "?": one, "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else re.escape(c)))
        i += 1
    return "^" + "".join(out) + "$"


def matches_any(path: Column, patterns: list[str], literal_separator: bool = False, ignore_case: bool = False) -> Column:
    """One alternation for all patterns, so a path is tested once."""
    if not patterns:
        return F.lit(False)
    joined = "|".join(glob_regex(p, literal_separator) for p in patterns)
    return path.rlike(f"(?i){joined}" if ignore_case else joined)


def include_exclude(path: Column, include: list[str], exclude: list[str]) -> Column:
    """No include pattern lets everything in; an exclude pattern wins."""
    wanted = matches_any(path, include) if include else F.lit(True)
    return wanted & ~matches_any(path, exclude)
