"""Listings of stores as a Spark data source: names, sizes and times, no contents.

Spark's own file sources leave out empty files and those whose names begin
with a dot or an underscore; an archive must not. One folder is listed
on the driver, and each folder below it is a partition, walked by its task.

Options say what is wanted: ``prefix`` decides where the listing begins, with ``direct`` only
that one folder is listed, and ``key`` asks for a single file, which is looked up and not listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from stowage.sources.files import filesystem, store_of

SCHEMA = "key string, size long, timestamp timestamp, path string"
#: Rows of a batch.
ROWS = 10_000


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url = options["path"].rstrip("/")
        self.store = store_of(options)
        self.prefix, self.key = options.get("prefix", ""), options.get("key")
        self.direct = options.get("direct", "false").lower() == "true"

    def _start(self) -> tuple:
        where, root = filesystem(self.url, self.store)
        folder = self.prefix.rpartition("/")[0]
        return where, root, f"{root}/{folder}" if folder else root

    def partitions(self) -> list[InputPartition]:
        where, root, start = self._start()
        if self.key is not None:
            return [Folder(f"{root}/{self.key}", False)]
        if self.direct:
            return [Folder(start, False)]
        return [Folder(start, False), *(Folder(i.path, True) for i in _listed(where, start) if i.type.name == "Directory")]

    def read(self, partition: Folder) -> Iterator:
        import pyarrow as pa

        where, root, _ = self._start()
        base, found = len(root.rstrip("/")) + 1, []

        def batch() -> pa.RecordBatch:
            keys = [i.path[base:] for i in found]
            times = [i.mtime_ns // 1000 for i in found]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([i.size for i in found], pa.int64()), pa.array(times, pa.timestamp("us", "UTC")), pa.array([f"{self.url}/{k}" for k in keys], pa.string())],
                names=["key", "size", "timestamp", "path"],
            )

        if self.key is not None:
            own = where.get_file_info(partition.path)
            if own.type.name == "File":
                found.append(own)
        folders = [partition.path] if self.key is None else []
        while folders:
            for i in _listed(where, folders.pop()):
                if i.type.name == "File":
                    found.append(i)
                    if len(found) == ROWS:
                        yield batch()
                        found.clear()
                elif i.type.name == "Directory" and partition.deep:
                    folders.append(i.path)
        if found:
            yield batch()


def _listed(where, folder: str) -> list:
    from pyarrow import fs

    return where.get_file_info(fs.FileSelector(folder, allow_not_found=True))


class Listing(DataSource):
    """``spark.read.format("stowage-listing").load(url)``: all files under a bucket or folder."""

    @classmethod
    def name(cls) -> str:
        return "stowage-listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)
