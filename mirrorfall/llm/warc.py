"""WARC archives with a two-level capture index.

Captures are written as WARC/1.1 records, one gzip member each. Their index lines are sorted by reversed-host URL key and
packed into compressed blocks; a sparse directory holds each block's first key. A lookup binary-searches the directory,
range-reads the blocks it names, and range-reads the records that their lines point to.

Archives lie in the shared folder and are reached through pyarrow.fs. Every task writes files of fresh names and returns
rows that point into them, so a task that is run again leaves at most an unreferenced file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, scratch_path, ship

_URL = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)")
_CAPTURE = "key string, page_id long, file string, offset long, length long"
_DIRECTORY = "first_key string, file string, offset long, length long, lines long"
_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"
#: Most directory rows that a lookup sends to every task; beyond them the keys are dealt in ranges of the directory.
DIRECTORY_ROWS = 200_000


def url_key(url: str | None) -> str:
    """`http://www.Example.com:8080/a?b` as `com,example,www:8080)/a?b`; a missing URL has the empty key."""
    if not url:
        return ""
    _, host, port, rest = _URL.match(url.strip()).groups()
    return ",".join(reversed(host.lower().split("."))) + (f":{port}" if port else "") + ")" + (rest or "/")


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record as a gzip member: a response, or a revisit that names the response with the same payload."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(f"%{b:02X}" if b <= 0x20 else chr(b) for b in (url or "").encode()).encode("latin-1").decode(errors="replace")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> dict:
    """The record's columns; raises ValueError where a response's payload does not have the stated digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"damaged record of {fields.get('WARC-Target-URI')}")
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None,
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": int(refers[len("<urn:page:") : -1]) if refers else None,
        "payload": payload.decode(errors="replace") if kind == "response" else None,
    }


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of `pages` (page_id, url, html) and returns its capture line (_CAPTURE).

    Of rows with equal payloads of at least `min_revisit_bytes` bytes, those with the largest page_id become responses and
    the others revisits of it. A null html is an empty payload. Rows that repeat that page_id and payload are responses
    too; where all page_ids of a payload are null, so are all of its rows. Only groups of two and more take part in the
    join, and a large group's rows are split by adaptive execution because both sides are shuffled.
    """
    base = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    groups = base.where(F.octet_length("html") >= min_revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    repeated = materialize(groups.where("n > 1 and first is not null").select("sha", "first"), "warc-repeated")
    dealt = base.join(repeated, "sha", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    schema = _schema(_CAPTURE)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        out, name, place = None, f"{uuid.uuid4().hex}.warc.gz", 0
        try:
            for batch in batches:
                lines = []
                for page_id, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    member = record_bytes(page_id, url, html.encode(), refers, date)
                    out.write(member)
                    lines.append((url_key(url), page_id, name, place, len(member)))
                    place += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*lines, strict=True), schema, strict=True)] if lines else [pa.array([], f.type) for f in schema], schema=schema)
        finally:
            if out is not None:
                out.close()

    return materialize(dealt.mapInArrow(write, _CAPTURE), "warc-captures")


def build_index(captures: DataFrame, folder: str, block_lines: int = 3000) -> DataFrame:
    """Sorts capture lines by key into blocks of `block_lines`, compressed one by one, and returns the sparse directory.

    The lines are range-partitioned by key and place, so captures of one hot key or host may fill many partitions.
    """
    schema = _schema(_DIRECTORY)
    parts = max(4, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", "file", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        rows, lines, out, place, name = [], [], None, 0, f"{uuid.uuid4().hex}.cdx.gz"

        def flush() -> None:
            nonlocal out, place
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            block = packer.compress("".join(json.dumps(x) + "\n" for x in lines).encode()) + packer.flush()
            out.write(block)
            rows.append((lines[0][0], name, place, len(block), len(lines)))
            place += len(block)
            lines.clear()

        try:
            for batch in batches:
                for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    lines.append(line)
                    if len(lines) >= block_lines:
                        flush()
            if lines:
                flush()
        finally:
            if out is not None:
                out.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    lines = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(lines.mapInArrow(pack, _DIRECTORY), "warc-directory")


def lookup(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """The records (_RECORD) of all captures whose URL key is in `keys` (column key; repeats count once).

    The directory is binary-searched for the blocks that can hold a key; each such block is read once, by range, and the
    captures found are read in the order of their places in the archives. The directory is cut into runs of
    DIRECTORY_ROWS blocks, each searched in turn, so what a task holds stays bounded.
    """
    spark = keys.sparkSession
    keys = keys.select("key").where("key is not null").distinct()
    total = directory.count()
    ordered = directory.orderBy("first_key", "file", "offset")
    found = None
    for start in range(0, max(total, 1), DIRECTORY_ROWS):
        run = ordered.offset(start).limit(DIRECTORY_ROWS + 1).collect()  # one more, to know where the run ends
        blocks = [tuple(r) for r in run[:DIRECTORY_ROWS]]
        after = run[DIRECTORY_ROWS][0] if len(run) > DIRECTORY_ROWS else None
        part = _captures_of(keys, spark.sparkContext.broadcast((blocks, after, start == 0)), folder)
        found = part if found is None else found.unionByName(part)
    parts = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = found.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    schema = _schema(_RECORD)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        name, source = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for file, offset, length in zip(*(batch.slice(at, 256).column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                    if file != name:
                        name, source = file, fs.open_input_file(f"{root}/{file}")
                    rows.append(parse_record(source.read_at(length, offset)))
                yield pa.RecordBatch.from_pylist(rows, schema)

    return dealt.mapInArrow(read, _RECORD)


def _captures_of(keys: DataFrame, blocks, folder: str) -> DataFrame:
    capture, search = _schema(_CAPTURE), _schema("block long, key string")

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, after, is_first = blocks.value
        firsts = [r[0] for r in rows]
        for batch in batches:
            hits = []
            for key in batch.column(0).to_pylist():
                if not firsts or (after is not None and key > after) or (not is_first and key < firsts[0]):
                    continue
                # A key's captures may start in the block before the first one that begins with it.
                hits += [(i, key) for i in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.string())], schema=search)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        rows = blocks.value[0]
        pairs = ((b, k) for batch in batches for b, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for block, group in groupby(pairs, key=lambda x: x[0]):
            wanted = {k for _, k in group}
            _, file, offset, length, _ = rows[block]
            with fs.open_input_file(f"{root}/{file}") as source:
                text = zlib.decompress(source.read_at(length, offset), 31).decode()
            hits = [line for line in map(json.loads, text.splitlines()) if line[0] in wanted]
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*hits, strict=True), capture, strict=True)], schema=capture)

    return keys.mapInArrow(seek, "block long, key string").repartition("block").sortWithinPartitions("block").mapInArrow(scan, _CAPTURE)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every row of `pages`, indexes the archives, and looks every page's URL key up again.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, as parsed from the records read back.
    """
    ship(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = scratch_path(spark, "warc")
    captures = write_archives(pages, folder)
    directory = build_index(captures, folder)
    records = lookup(captures.select("key"), directory, folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
