"""Fingerprints, distances, thresholds, attribute bits and slices of content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB = 1024
TIER2_FLOOR, WINDOW = 256 * KIB, 64 * KIB
#: Attribute bits of placeholder files.
RECALL_ON_OPEN, RECALL_ON_DATA_ACCESS, REPARSE_POINT, DEDUP_TAG = 0x40000, 0x400000, 0x400, 0x80000013
#: Format families by extension.
FORMATS = {"zip": ("zip", "docx", "xlsx", "pptx", "jar", "epub", "odt", "ods", "apk"), "jpeg": ("jpg", "jpeg"), "png": ("png",), "mp3": ("mp3",), "mp4": ("mp4", "m4a", "m4v", "mov"), "mkv": ("mkv", "webm"), "pdf": ("pdf",)}


def sign_fingerprint(vector: Column) -> Column:
    """64 sign bits of a 64-element vector, element 0 the lowest."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def average_hamming(a: Column, b: Column) -> Column:
    """Mean differing bits over the shorter length of two integer arrays; 0 if one is empty."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.when(n > 0, F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / n).otherwise(F.lit(0.0))


def tau_for_n(n: Column, base: int = 5) -> Column:
    """Threshold for n items: one less for each power of ten above a hundred, three at least."""
    digits = F.length(F.call_function("div", n, F.lit(100)).cast("string")) - 1
    return F.when(n < 100, F.lit(max(base, 3))).otherwise(F.greatest(F.lit(3), F.lit(base) - digits)).cast("bigint")


def classify_placeholder(attributes: Column, reparse_tag: Column) -> Column:
    has = lambda bit: attributes.bitwiseAND(F.lit(bit)) != 0
    return (
        F.when(has(RECALL_ON_OPEN), "recall-on-open")
        .when(has(RECALL_ON_DATA_ACCESS), "recall-on-data-access")
        .when(has(REPARSE_POINT) & (reparse_tag == DEDUP_TAG), "reparse-dedup")
        .when(has(REPARSE_POINT), "other-reparse")
        .otherwise("none")
    )


def blocks_read(placeholder: Column, allow_recall: bool = False) -> Column:
    recall = placeholder.isin("recall-on-open", "recall-on-data-access")
    return (placeholder == "other-reparse") | (F.lit(False) if allow_recall else recall)


def blocks_action(placeholder: Column, allow_dedup: bool = False) -> Column:
    return (placeholder != "none") & ~((placeholder == "reparse-dedup") & F.lit(allow_dedup))


def format_family(ext: Column) -> Column:
    out = F.lit(None).cast("string")
    for family, extensions in FORMATS.items():
        out = F.when(ext.isin(list(extensions)), family).otherwise(out)
    return out


def head_slice(content: Column, tier1_bytes: int = 4096) -> Column:
    """The first bytes of content; text counts as its UTF-8 bytes, not its characters."""
    return F.substring(content.cast("binary"), 1, tier1_bytes)


def sampled_slice(content: Column, size: Column, floor: int = TIER2_FLOOR, window: int = WINDOW) -> Column:
    """Head, middle and tail of content of at least `floor` bytes, else NULL; text counts as its UTF-8 bytes."""
    content = content.cast("binary")
    middle = F.call_function("div", size - window, F.lit(2)).cast("int")
    return F.when(size >= floor, F.concat(F.substring(content, 1, window), F.substring(content, middle + 1, F.lit(window)), F.substring(content, (size - window + 1).cast("int"), F.lit(window))))


def tier_bytes(tier: int, size: Column, tier1_bytes: int = 4096) -> Column:
    """Bytes that a tier reads of one file."""
    return (F.lit(WINDOW), F.least(size, F.lit(tier1_bytes)), F.lit(3 * WINDOW), size)[tier].cast("bigint")
