"""File inventories as a Python data source: one partition for each root's first-level folder."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import MARKER, TICKS_TO_EPOCH

SCHEMA = "path string, size bigint, mtime_ticks bigint, volume string, file_ref bigint, root string"


class _Subtree(InputPartition):
    def __init__(self, root: str, path: str, recurse: bool) -> None:
        super().__init__((root, path, recurse))


class InventorySource(DataSource):
    """format("inventory"): options roots (separated by newlines), follow_links (false).

    Regular files of any size, hidden ones included, with device and inode as identity. Links are skipped unless followed;
    a folder that was already entered, by its device and inode, is not entered again. Own marker files are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return InventoryReader(self.options)


class InventoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.roots = [os.path.abspath(r) for r in options.get("roots", "").split("\n") if r]
        self.follow = options.get("follow_links", "false").lower() == "true"
        missing = [r for r in self.roots if not os.path.lexists(r)]
        if missing:
            raise FileNotFoundError(f"no such root: {missing[0]}")

    def partitions(self) -> list[InputPartition]:
        out = []
        for root in self.roots:
            out.append(_Subtree(root, root, False))
            if os.path.isdir(root):
                out += [_Subtree(root, e.path, True) for e in os.scandir(root) if e.is_dir(follow_symlinks=self.follow)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        root, path, recurse = partition.value
        if not os.path.isdir(path):
            yield from self._file(root, path)
            return
        seen, todo = set(), [path]
        while todo:
            folder = todo.pop()
            info = os.stat(folder)
            if (info.st_dev, info.st_ino) in seen:
                continue
            seen.add((info.st_dev, info.st_ino))
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                continue
            for entry in entries:
                if entry.is_symlink() and not self.follow:
                    continue
                if entry.is_dir():
                    if recurse:
                        todo.append(entry.path)
                else:
                    yield from self._file(root, entry.path)

    def _file(self, root: str, path: str) -> Iterator[tuple]:
        name = os.path.basename(path)
        if name.startswith(f"{MARKER}-") or name.endswith((MARKER, f"{MARKER}-clone-tmp")):
            return
        try:
            info = os.stat(path, follow_symlinks=self.follow)
        except OSError:
            return
        if stat.S_ISREG(info.st_mode):
            yield (path, info.st_size, info.st_mtime_ns // 100 + TICKS_TO_EPOCH, f"dev-{info.st_dev}", info.st_ino, root)


def read_inventory(spark: SparkSession, roots: list[str], follow_links: bool = False):
    """The inventory of the roots; FileNotFoundError, before anything runs, where a root is missing."""
    missing = [r for r in roots if not os.path.lexists(r)]
    if missing:
        raise FileNotFoundError(f"no such root: {missing[0]}")
    spark.dataSource.register(InventorySource)
    df = spark.read.format("inventory").option("roots", "\n".join(roots)).option("follow_links", str(follow_links).lower()).load()
    return df.dropDuplicates(["path"])
