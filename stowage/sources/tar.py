"""Tar archives as Spark data sources.

``stowage-tar`` reads: one header walk on the driver, which seeks over all data, cuts the archive into
spans and keeps only their bounds; tasks walk the headers of their span again and read what is wanted. Filters are an
option (``filters``, a JSON list of texts), so the data of entries that none takes is never read.
``stowage-tar-writer`` writes: every row says where its bytes stand in the archive, so tasks write
them in parallel.

Files are opened as ``sources.files`` says: local ones, or those of whatever file
system pyarrow knows for the scheme.
"""

from __future__ import annotations

import heapq
import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from stowage.functions.selectors import EntryFilter
from stowage.model import TAR_BLOCK, TAR_NAME, CorruptArchive, StowageError
from stowage.sources.files import filesystem, open_path, store_of
from stowage.sources.listing import Listing

ENTRY_SCHEMA = "key string, size long, header_offset long, data_offset long, type string"
#: Entries of a span.
SPAN = 10_000
#: Runs of a task that its message holds; runs of all tasks' lists that the commit holds at once.
LISTED, HELD = 64, 1 << 16
PART_SCHEMA = "key string, size long, part_number int, range_start long, range_end long, data binary"


def number(field: bytes) -> int:
    """A numeric header field: octal text, or base 256 if the first bit is set."""
    if field and field[0] & 0x80:
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
    text = field.split(b"\0")[0].strip()
    try:
        return int(text, 8) if text else 0
    except ValueError as e:
        raise CorruptArchive(f"no number: {field!r}") from e


@dataclass
class Entry:
    key: str
    size: int
    header_offset: int
    data_offset: int
    type: str


def headers(f, at: int = 0, stop: int | None = None) -> Iterator[Entry]:
    """Entries of an archive in order, from its headers only, from one that begins at ``at`` up to ``stop``. Long names and pax records belong to the entry after them."""
    begun, name, size = None, None, None
    while stop is None or at < stop:
        f.seek(at)
        block = f.read(TAR_BLOCK)
        if len(block) < TAR_BLOCK or not any(block):
            return
        if number(block[148:156]) != sum(block[:148]) + 8 * 32 + sum(block[156:]):
            raise CorruptArchive(f"bad checksum of the header at {at}")
        kind, length, data = chr(block[156] or 48), number(block[124:136]), at + TAR_BLOCK
        begun = at if begun is None else begun
        after = data + -(-length // TAR_BLOCK) * TAR_BLOCK
        if kind == "L":
            name = f.read(length).rstrip(b"\0")
        elif kind == "x":
            records, i = f.read(length), 0
            while i < len(records):
                n = int(records[i : records.index(b" ", i)])
                k, _, v = records[records.index(b" ", i) + 1 : i + n - 1].partition(b"=")
                name, size = (v if k == b"path" else name), (int(v) if k == b"size" else size)
                i += n
        elif kind not in "gK":
            own = block[:100].split(b"\0")[0]
            if block[257:263] == b"ustar\0" and block[345]:
                own = block[345:500].split(b"\0")[0] + b"/" + own
            length = length if size is None else size
            after = data + (-(-length // TAR_BLOCK) * TAR_BLOCK if kind in "07S" else 0)
            yield Entry((name if name is not None else own).decode("utf-8", "replace"), length, begun, data, kind)
            begun, name, size = None, None, None
        at = after


@dataclass
class Span(InputPartition):
    """Entries from one offset to another; of a single large one, the parts from ``first`` to ``last``."""

    start: int
    stop: int
    first: int = 0
    last: int | None = None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        from stowage.functions.sizes import parse_size

        self.path, self.store = options["path"], store_of(options)
        self.parts = options.get("parts", "false").lower() == "true"
        self.all = options.get("allTypes", "false").lower() == "true"
        self.chunk = parse_size(options.get("chunkSize", "8MiB"))
        self.threshold = parse_size(options.get("multipartThreshold", "8MiB"))
        self.filters = [EntryFilter.parse(f) for f in json.loads(options.get("filters", "[]"))]

    def wanted(self, e: Entry) -> bool:
        return (self.all or e.type in "07") and (not self.filters or any(f.takes(e.key) for f in self.filters))

    def partitions(self) -> list[InputPartition]:
        """Spans of entries with about a chunk of wanted data together; a large entry has spans of its own."""
        out, start, n, held, end = [], 0, 0, 0, 0
        with open_path(self.path, self.store) as f:
            for e in headers(f):
                wanted = self.wanted(e)
                end = e.data_offset + e.size
                if self.parts and wanted and e.size >= self.threshold:
                    if n:
                        out.append(Span(start, e.header_offset))
                    out += [Span(e.header_offset, e.data_offset, i, i + 1) for i in range(max(1, -(-e.size // self.chunk)))]
                    start, n, held = end, 0, 0
                    continue
                if not n:
                    start = e.header_offset
                n, held = n + wanted, held + (e.size if self.parts and wanted else 0)
                if held >= self.chunk or n >= SPAN:
                    out.append(Span(start, end))
                    n, held = 0, 0
        return [*out, Span(start, end)] if n or not out else out

    def read(self, partition: Span) -> Iterator[tuple]:
        with open_path(self.path, self.store) as f:
            for e in filter(self.wanted, headers(f, partition.start, partition.stop)):
                if not self.parts:
                    yield e.key, e.size, e.header_offset, e.data_offset, e.type
                    continue
                count = 1 if e.size < self.threshold else max(1, -(-e.size // self.chunk))
                for i in range(partition.first, count if partition.last is None else partition.last):
                    a = i * self.chunk
                    b = e.size if i + 1 == count else a + self.chunk
                    f.seek(e.data_offset + a)
                    yield e.key, e.size, i, a, b, f.read(b - a)


class TarSource(DataSource):
    """``spark.read.format("stowage-tar").load(path)``: the entries; with option ``parts`` their data, in byte ranges."""

    @classmethod
    def name(cls) -> str:
        return "stowage-tar"

    def schema(self) -> str:
        return PART_SCHEMA if self.options.get("parts", "false").lower() == "true" else ENTRY_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def header_block(name: bytes, size: int, kind: bytes = b"0", gnu: bool = True) -> bytes:
    """A header with a name and a size; times, modes and owners stay zero."""
    block = bytearray(TAR_BLOCK)
    block[: min(len(name), TAR_NAME)] = name[:TAR_NAME]
    for at, width in ((100, 8), (108, 8), (116, 8), (136, 12)):
        block[at : at + width] = b"0" * (width - 1) + b"\0"
    block[124:136] = b"%011o\0" % size if size < 8**11 else b"\x80" + size.to_bytes(11, "big")
    block[156:157] = kind
    block[257:265] = b"ustar  \0"
    block[148:156] = b" " * 8
    block[148:156] = b"%06o\0 " % sum(block)
    return bytes(block)


def entry_header(key: str, size: int) -> bytes:
    """All that stands before an entry's data."""
    name = key.encode()
    if len(name) <= TAR_NAME:
        return header_block(name, size)
    padding = -(len(name) + 1) % TAR_BLOCK
    return header_block(b"././@LongLink", len(name) + 1, b"L") + name + b"\0" * (1 + padding) + header_block(name, size)


@dataclass
class Piece(WriterCommitMessage):
    """A file that a task wrote, and the list of its runs of bytes: a file too, if there are more than ``LISTED``, so that no driver holds the runs of all."""

    path: str
    runs: list | str
    events: str | None = None


def _whole(rows: Iterator) -> Iterator[tuple]:
    """Each row with its offset and bytes, with the header before an entry's first part and the padding after its last."""
    for r in rows:
        data, offset = bytes(r.data or b""), r.data_offset + r.range_start
        if r.range_start == 0:
            data, offset = entry_header(r.key, r.size) + data, r.header_offset
        if r.range_end == r.size:
            data += b"\0" * (-r.size % TAR_BLOCK)
        yield r, offset, data


def _mark(block: bytes) -> int:
    """Length and checksum of at most a block of bytes, to find them again."""
    return len(block) << 32 | zlib.crc32(block)


class _Runs:
    """Runs of bytes that a task has written: offset in the archive, length, offset in the file, and marks of the first and the last bytes."""

    FIELDS = "qqqqq"

    def __init__(self) -> None:
        self.columns = [array("q") for _ in self.FIELDS]

    def add(self, offset: int, data: bytes, at: int) -> None:
        """Adds bytes; those that go on where the last run ends become part of it."""
        n, (offsets, lengths, places, first, last) = len(data), self.columns
        end = _mark(data[-TAR_BLOCK:])
        if offsets and offsets[-1] + lengths[-1] == offset and places[-1] + lengths[-1] == at:
            lengths[-1] += n
            last[-1] = end
        else:
            for column, x in zip(self.columns, (offset, n, at, _mark(data[:TAR_BLOCK]), end), strict=True):
                column.append(x)

    def listed(self, where, name: str) -> list | str:
        """The runs in the order of the archive, or the name of the file that they were written to."""
        rows = sorted(zip(*self.columns, strict=True))
        if len(rows) <= LISTED:
            return rows
        where.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with where.open_output_stream(name) as out:
            for i in range(0, len(rows), LISTED):
                out.write(b"".join(struct.pack(self.FIELDS, *r) for r in rows[i : i + LISTED]))
        return name

    @classmethod
    def of(cls, where, m: Piece, held: int) -> Iterator[tuple]:
        """``offset, length, path, place, first mark, last mark`` of every run, with at most ``held`` of them in memory."""
        if not isinstance(m.runs, str):
            yield from ((offset, n, m.path, *rest) for offset, n, *rest in m.runs)
            return
        at, width = 0, struct.calcsize(cls.FIELDS)
        while True:
            with where.open_input_file(m.runs) as f:  # closed between reads: there are as many files as tasks
                f.seek(at)
                data = f.read(held * width)
            if not data:
                return
            yield from ((offset, n, m.path, *rest) for offset, n, *rest in struct.iter_unpack(cls.FIELDS, data))
            at += len(data)


class _Events:
    """The events of a task's rows, as a Parquet file of its own attempt; the commit moves those of successful ones to the log."""

    SCHEMA = "event string, key string, part_number int, bytes long"

    def __init__(self, folder: str, store: dict[str, str], chunk: int) -> None:
        import pyarrow as pa
        import pyarrow.parquet as pq

        self.where, root = filesystem(folder, store)
        self.chunk = chunk
        self.where.create_dir(f"{root}/_attempts", recursive=True)
        self.name = f"{uuid.uuid4().hex}.parquet"
        self.types = pa.schema([("event", pa.string()), ("key", pa.string()), ("part_number", pa.int32()), ("bytes", pa.int64())])
        self.file = self.where.open_output_stream(f"{root}/_attempts/{self.name}")
        self.out, self.rows = pq.ParquetWriter(self.file, self.types), []

    def add(self, r) -> None:
        """What reading and writing one part means for its object and the archive."""
        n = r.range_end - r.range_start
        if r.range_start == 0:
            self.rows.append(("input_object_download_started", r.key, None, r.size))
        number = r.range_start // self.chunk
        self.rows += [(e, r.key, number, n) for e in ("input_part_unordered_downloaded", "input_part_downloaded", "archive_part_written")]
        if r.range_end == r.size:
            entry = r.data_offset - r.header_offset + -(-r.size // TAR_BLOCK) * TAR_BLOCK
            self.rows += [("input_object_download_completed", r.key, None, r.size), ("archive_object_written", r.key, None, r.size), ("archive_bytes_written", r.key, None, entry)]
        if len(self.rows) > 20_000:
            self.flush()

    def flush(self) -> None:
        import pyarrow as pa

        cols = list(zip(*self.rows, strict=True)) or [[]] * 4
        self.out.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, self.types, strict=True)], schema=self.types))
        self.rows = []

    def close(self) -> str:
        self.flush()
        self.out.close()
        self.file.close()
        return self.name


class _Writer(DataSourceWriter):
    """Writes rows where their offsets say.

    On a mounted file system every task writes its bytes in place, into a
    file beside the target. The driver creates it and tasks only open it, so a folder that is not the
    same for all machines is an error and not a gap. The commit looks for what tasks say they
    wrote, adds the trailer and renames the file. A task that
    is run again writes the same bytes to the same places. Rows in any order make as many runs of bytes as there
    are rows: each task writes a sorted list of its own, and the commit merges these as it reads them.

    Other stores have no writes in place: there each attempt writes a file of
    its own, and the commit streams these, in order, into the one object.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.store = options["path"], store_of(options)
        self.work = f"{self.path}.parts-{uuid.uuid4().hex}"
        self.events, self.chunk = options.get("events"), int(options.get("chunk", 8 << 20))
        self.lists = f"{self.work}.runs"
        if self._mounted():
            os.close(os.open(filesystem(self.work, self.store)[1], os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644))

    def _listed(self, runs: _Runs) -> list | str:
        where, folder = filesystem(self.lists, self.store)
        return runs.listed(where, f"{folder}/{uuid.uuid4().hex}")

    def _merged(self, messages: list) -> Iterator[tuple]:
        """The runs of all tasks in the order of the archive."""
        where, held = filesystem(self.lists, self.store)[0], max(16, HELD // max(1, len(messages)))
        return heapq.merge(*(_Runs.of(where, m, held) for m in messages))

    def _mounted(self) -> bool:
        from pyarrow import fs

        return isinstance(filesystem(self.path, self.store)[0], fs.LocalFileSystem)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        where, name = filesystem(self.work, self.store)
        runs, log = _Runs(), _Events(self.events, self.store, self.chunk) if self.events else None
        if self._mounted():
            try:
                fd = os.open(name, os.O_WRONLY)
            except FileNotFoundError as e:
                raise StowageError(f"{self.path}: not the same folder here as on the driver") from e
            try:
                for r, offset, data in _whole(rows):
                    done = 0
                    while done < len(data):
                        done += os.pwrite(fd, memoryview(data)[done:], offset + done)
                    runs.add(offset, data, offset)
                    if log:
                        log.add(r)
                os.fsync(fd)
            finally:
                os.close(fd)
            return Piece(name, self._listed(runs), log.close() if log else None)
        where.create_dir(name, recursive=True)
        own, at = f"{name}/{uuid.uuid4().hex}", 0
        with where.open_output_stream(own) as out:
            for r, offset, data in _whole(rows):
                out.write(data)
                runs.add(offset, data, at)
                at += len(data)
                if log:
                    log.add(r)
        return Piece(own, self._listed(runs), log.close() if log else None)

    def commit(self, messages: list) -> None:
        messages = [m for m in messages if m]
        end = 0
        for offset, n, *_ in self._merged(messages):
            if offset != end:
                self._clean()
                raise CorruptArchive(f"bytes {end} to {offset} of the archive are missing or there twice")
            end += n
        if self._mounted():
            self._close_in_place(messages, end)
        else:
            where, name = filesystem(self.path, self.store)
            with where.open_output_stream(name) as out:
                for _, n, path, at, *_ in self._merged(messages):
                    with where.open_input_file(path) as f:
                        f.seek(at)
                        while n:
                            data = f.read(min(n, 8 << 20))
                            if not data:
                                raise CorruptArchive(f"{path} ends too early")
                            out.write(data)
                            n -= len(data)
                out.write(b"\0" * (2 * TAR_BLOCK))
            self._clean()
        if self.events:
            where, root = filesystem(self.events, self.store)
            for m in messages:
                where.move(f"{root}/_attempts/{m.events}", f"{root}/{m.events}")
            where.delete_dir(f"{root}/_attempts") if messages else None

    def _close_in_place(self, messages: list, end: int) -> None:
        """Checks what is there, adds the trailer and gives the file its name."""
        name = filesystem(self.work, self.store)[1]
        try:
            fd = os.open(name, os.O_RDWR)
        except FileNotFoundError as e:
            self._clean()
            raise CorruptArchive(f"{self.path}: what tasks have written is gone") from e
        try:
            if os.fstat(fd).st_size != end:
                raise CorruptArchive(f"{self.path}: tasks have written {end} bytes, but {os.fstat(fd).st_size} are there; is the folder the same for all machines?")
            for offset, n, _, _, first, last in self._merged(messages):
                for at, mark in ((offset, first), (offset + n - (last >> 32), last)):
                    if _mark(os.pread(fd, mark >> 32, at)) != mark:
                        raise CorruptArchive(f"{self.path}: bytes at {at} are not those that a task has written")
            os.ftruncate(fd, end + 2 * TAR_BLOCK)
            os.fsync(fd)
        except CorruptArchive:
            self._clean()
            raise
        finally:
            os.close(fd)
        os.replace(name, filesystem(self.path, self.store)[1])
        self._clean()

    def abort(self, messages: list) -> None:
        self._clean()

    def _clean(self) -> None:
        from pyarrow import fs

        for path in (self.work, self.lists):
            where, name = filesystem(path, self.store)
            kind = where.get_file_info(name).type
            if kind == fs.FileType.Directory:
                where.delete_dir(name)
            elif kind == fs.FileType.File:
                where.delete_file(name)


class TarSink(DataSource):
    """``df.write.format("stowage-tar-writer").save(path)``: rows of ``key, size, header_offset, data_offset, range_start, range_end, data``."""

    @classmethod
    def name(cls) -> str:
        return "stowage-tar-writer"

    def schema(self) -> str:
        return "key string, size long, header_offset long, data_offset long, range_start long, range_end long, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def register(spark) -> None:
    """Makes the formats known to a session."""
    spark.dataSource.register(Listing)
    spark.dataSource.register(TarSource)
    spark.dataSource.register(TarSink)
