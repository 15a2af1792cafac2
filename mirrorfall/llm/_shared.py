"""Shared plumbing of the training-data operators: scratch tables, Arrow text access, byte-level words."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_TEXT_SLICE_BYTES = 1 << 20
_CALL_BYTES = 3 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}
_collected = 0.0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset.

    Where it is unset, a local session gets a temporary folder and a cluster a folder in its warehouse.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        local = spark.sparkContext.master.split("[")[0] == "local"
        path = tempfile.mkdtemp(prefix="mirrorfall-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/mirrorfall-scratch"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session has ended, and with it the means to reach the folder
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/mirrorfall-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_drop_at_exit, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def materialize_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As materialize(), with rows dealt out by `key` as a shuffle deals them out, so that joins on it leave them in place."""
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"spark_catalog.default.mirrorfall_{uuid.uuid4().hex[:12]}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, key).saveAsTable(table)
    out = spark.table(table)
    out._scratch, out._table = path, table
    return out


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark's cleaner free the shuffles of jobs that are done: it does when the driver has collected their plans, for
    which one collection is not enough."""
    global _collected
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    _collected = time.monotonic()


def drop(*tables: DataFrame) -> None:
    """Deletes tables of materialize() and materialize_by() that nothing will read again and, every few seconds, the shuffles of jobs that are done."""
    for table in tables:
        if hasattr(table, "_table"):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._table}")
        _delete(table.sparkSession, table._scratch)
    if tables and time.monotonic() - _collected > 5:
        collect_garbage(tables[0].sparkSession)


def give_back() -> None:
    """Hands memory that this Python worker has freed back to the system: the worker stays for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another allocator
        pass


def fresh(name: str, taken: list[str]) -> str:
    """`name`, or with underscores in front where `taken` has it (in any case)."""
    names = {c.lower() for c in taken}
    while name.lower() in names:
        name = f"_{name}"
    return name


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever they run: its sources go to them once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="mirrorfall-")) / "mirrorfall_sources.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(path))
    atexit.register(shutil.rmtree, path.parent, True)
    _shipped.add(context.applicationId)


def utf8_parts(column: pa.Array, limit: int = _TEXT_SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of about `limit` bytes (a longer text stands alone).

    Yields first row, past-last row, the run's bytes and its row offsets into them; a null reads as an empty text.
    """
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash multiplier and of its inverse modulo 2^64, at least n of each."""
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        for key, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[key] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """Distinct values in order (a plain sort is faster here than numpy's hashing)."""
    x = np.sort(x)
    first = np.ones(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    return x[first]


def prefix_hashes(units: np.ndarray) -> np.ndarray:
    """H with H[0] = 0, so that (H[e] - H[s]) * inverse**s depends on units[s:e] alone."""
    up, _ = powers(len(units) + 1)
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units.astype(np.uint64) * up[: len(units)], out=out[1:])
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of word bytes; a run never crosses a row."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    sums = prefix_hashes(data.astype(np.uint16) + np.uint16(1))
    _, down = powers(len(data) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts])


#: ASCII letters A to Z to lower case; other bytes stay.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False


def _cuts(column: pa.Array, rows: int) -> Iterator[tuple[int, int]]:
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(ends):
        limit = (ends[at - 1] if at else 0) + _CALL_BYTES
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, limit, "right"))))
        yield at, end
        at = end


def map_text(df: DataFrame, text: str, added: str, compute, keep: list[str] | None = None, rows: int = 4096) -> DataFrame:
    """Rows of df (its columns `keep`, all by default) with the columns of the DDL string `added` behind them.

    compute(column) takes an Arrow string column and gives the list of added Arrow columns. It runs on executors, on at
    most `rows` rows and about _CALL_BYTES of text at once. A column of df that has the name of an added one gives way to it.
    """
    ship(df.sparkSession)
    new = df.sparkSession.createDataFrame([], added).schema
    made = {f.name.lower() for f in new}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in made]
    source = fresh("__text", keep)
    schema = df.select(*keep).schema
    for field in new:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in _cuts(batch.column(len(keep)), rows):
                part = batch.slice(at, end - at)
                columns = [part.column(i) for i in range(len(keep))] + compute(part.column(len(keep)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        give_back()

    return df.select(*keep, df[text].alias(source)).mapInArrow(run, schema)
