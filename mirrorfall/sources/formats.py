"""Format fingerprints: a digest of what identifies a media or container file without its whole content.

Every parser takes the bytes and returns the parts to digest, or None where the file is not what its extension says.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.bits import FORMATS

_FAMILY = {ext: family for family, extensions in FORMATS.items() for ext in extensions}


def zip_parts(data: bytes) -> bytes | None:
    """Name, size and checksum of every entry, sorted."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            return repr(sorted((i.filename, i.file_size, i.CRC) for i in archive.infolist())).encode()
    except (zipfile.BadZipFile, ValueError, struct.error):
        return None


def png_parts(data: bytes) -> bytes | None:
    """Header, text chunks, and the beginning of the first image chunk."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    out, at, image = [], 8, False
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind in (b"IHDR", b"tEXt", b"iTXt", b"zTXt"):
            out.append(kind + body)
        elif kind == b"IDAT" and not image:
            out.append(body[:256])
            image = True
        at += size + 12
    return b"".join(out) if image else None


def jpeg_parts(data: bytes) -> bytes | None:
    """Application segments and the frame's dimensions, up to the first scan."""
    if data[:2] != b"\xff\xd8":
        return None
    out, at = [], 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if marker == 0xDA:
            break
        if 0xE0 <= marker <= 0xEF:
            out.append(data[at : at + 2 + size])
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            out.append(data[at + 5 : at + 9])
        at += 2 + size
    return b"".join(out) or None


def pdf_parts(data: bytes) -> bytes | None:
    """The trailer's window, and 64 KiB from where its last startxref points."""
    if data[:5] != b"%PDF-":
        return None
    tail = data[-2048:]
    found = tail.rfind(b"startxref")
    try:
        place = int(tail[found + 9 :].split()[0]) if found >= 0 else len(data)
    except (IndexError, ValueError):
        return None
    return tail + data[place : place + 65536]


def mp3_parts(data: bytes) -> bytes | None:
    """The tag's size, the first audio frame's header and the length behind the tag."""
    at = 0
    if data[:3] == b"ID3" and len(data) >= 10:
        a, b, c, d = data[6:10]
        at = 10 + (a << 21 | b << 14 | c << 7 | d)
    head = data[at : at + 4]
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    return data[:at] + head + struct.pack(">Q", len(data) - at)


def mp4_parts(data: bytes) -> bytes | None:
    """Movie and track headers and sample sizes, from a walk of the boxes to a depth of six."""
    out: list[bytes] = []

    def walk(at: int, end: int, depth: int) -> None:
        for _ in range(1024):
            if at + 8 > end or depth > 6:
                return
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            size = end - at if size == 0 else size
            if size < 8:
                return
            if kind in (b"mvhd", b"tkhd", b"stsz"):
                out.append(kind + data[at + 8 : min(at + size, end)])
            elif kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
                walk(at + 8, min(at + size, end), depth + 1)
            at += size

    walk(0, len(data), 0)
    return b"".join(out) or None


def mkv_parts(data: bytes) -> bytes | None:
    """The first 4 KiB, which hold the header and the segment's information."""
    return data[:4096] if data[:4] == b"\x1a\x45\xdf\xa3" else None


PARSERS = {"zip": zip_parts, "png": png_parts, "jpeg": jpeg_parts, "pdf": pdf_parts, "mp3": mp3_parts, "mp4": mp4_parts, "mkv": mkv_parts}


def fingerprint(path: str | None, data: bytes | None) -> str | None:
    """SHA-256 over the family's name and the parser's parts; None for other formats and damaged files."""
    name = (path or "").rsplit("/", 1)[-1]
    family = _FAMILY.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None
    if family is None or data is None:
        return None
    try:
        parts = PARSERS[family](data)
    except (struct.error, ValueError, IndexError):
        return None
    return None if parts is None else hashlib.sha256(family.encode() + b"\0" + parts).hexdigest()


def with_fingerprint(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Adds t0, the format fingerprint, without moving content between rows."""
    schema = StructType([*files.schema.fields, StructField("t0", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                names, data = (part.column(part.schema.get_field_index(c)).to_pylist() for c in (path, content))
                t0 = pa.array([fingerprint(n, d) for n, d in zip(names, data, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, t0], names=[*part.schema.names, "t0"])

    return files.mapInArrow(run, schema)


def hash_files(files: DataFrame, tier: str = "full", tier1_bytes: int = 4096, floor: int = 256 << 10, window: int = 64 << 10) -> DataFrame:
    """path, hash (NULL where the file cannot be read) of files on a path that executors share.

    Each tier reads its own bytes only: the head, three windows of files of at least `floor` bytes, or everything in
    pieces of 1 MiB.
    """

    def digest(path: str) -> str | None:
        try:
            with open(path, "rb") as file:
                out = hashlib.sha256()
                if tier == "head":
                    out.update(file.read(tier1_bytes))
                elif tier == "sampled":
                    size = file.seek(0, 2)
                    if size < floor:
                        return None
                    for at in (0, (size - window) // 2, size - window):
                        file.seek(at)
                        out.update(file.read(window))
                else:
                    while piece := file.read(1 << 20):
                        out.update(piece)
                return out.hexdigest()
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([digest(p) for p in paths], pa.string())], names=["path", "hash"])

    return files.select("path").mapInArrow(run, "path string, hash string")
