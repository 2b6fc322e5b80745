"""The two jobs: create an archive and extract one."""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions.selectors import EntryFilter, Selector, scopes
from stowage.functions.urls import SCHEMES, parse_location
from stowage.model import Config, CorruptArchive, NoInputs, StowageError
from stowage.operators.events import CREATE_EVENTS, EXTRACT_EVENTS
from stowage.operators.events import summary as event_summary
from stowage.operators.extract import marked, summary, target_key
from stowage.operators.parts import read_parts
from stowage.plans.create import check_inputs, check_plan, dedupe, select_any, totals
from stowage.plans.index import archive_index, archive_totals, check_keys
from stowage.plans.scale import checkpoint_dir
from stowage.sources.catalog import list_bucket
from stowage.sources.files import filesystem, open_path, store_options
from stowage.sources.tar import register


class Progress(Protocol):
    """Told about the steps of a job; ``event`` is one of those in ``operators.events``."""

    def __call__(self, event: str, **values: int | float | str | None) -> None: ...


def silent(event: str, **values: int | float | str | None) -> None:
    """Tells nobody."""


@dataclass(frozen=True)
class CreateResult:
    n_objects: int
    n_bytes: int
    archive_bytes: int
    seconds: float


@dataclass(frozen=True)
class ExtractResult:
    extracted_objects: int
    extracted_bytes: int
    skipped_objects: int
    skipped_bytes: int
    seconds: float


def split_input(text: str) -> tuple[str, str | None]:
    """Bucket URL and selector text of an input. A directory's selector follows after ``//``."""
    if "://" in text and text.split("://", 1)[0] in SCHEMES:
        where = parse_location(text)
        return f"{text.split('://', 1)[0]}://{where.bucket}", where.key
    scheme, sep, rest = text.partition("://") if "://" in text else ("", "", text)
    root, _, selector = rest.partition("//")
    return f"{scheme}{sep}{root}", selector or None


def gather(spark: SparkSession, inputs: list[str], allow_empty: bool = False, store: dict[str, str] | None = None) -> DataFrame:
    """All objects of all inputs, each once, after checking that every input matches something.

    Only what inputs can match is listed (``scopes``), once: the listing is kept in the checkpoint folder, and
    all checks and the archive's plan are of the same objects.
    """
    by_bucket: dict[str, list[Selector]] = {}
    for text in inputs:
        root, selector = split_input(text)
        by_bucket.setdefault(root, []).append(Selector.parse(selector))
    if not by_bucket:
        raise NoInputs("an archive needs at least one input")
    checkpoint_dir(spark)
    out: DataFrame | None = None
    for root, selectors in by_bucket.items():
        listed = reduce(DataFrame.unionByName, (list_bucket(spark, root, s, store) for s in scopes(selectors)))
        objects = dedupe(listed).checkpoint()
        check_inputs(objects, selectors, root, allow_empty)
        found = select_any(objects, selectors)
        out = found if out is None else out.unionByName(found)
    return dedupe(out).checkpoint() if len(by_bucket) > 1 else out


def check_path(spark: SparkSession, path: str, config: Config) -> None:
    """Raises if a plain path may be another folder on each machine."""
    if is_mounted(path) and not spark.sparkContext.master.startswith("local") and not config.shared_paths:
        raise StowageError(f"{path}: set shared_paths if this is the same folder on all machines of the cluster")


def is_mounted(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


def read_ranges(parts: DataFrame, store: dict[str, str] | None = None) -> DataFrame:
    """Adds ``data``: the bytes of each range of each file, read by its task, one range at a time."""
    import pyarrow as pa

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in parts.schema if f.name != 'path')}, data binary"
    names = [c for c in parts.columns if c != "path"]

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for k, r in enumerate(rows):
                if r["range_end"] > r["range_start"]:
                    with open_path(r["path"], store) as f:
                        f.seek(r["range_start"])
                        data = f.read(r["range_end"] - r["range_start"])
                else:
                    data = b""
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(one.schema.get_field_index(c)) for c in names), pa.array([data], pa.binary())], names=[*names, "data"])

    return parts.mapInArrow(run, schema)


def tell(progress: Progress, kinds: tuple[str, ...], counts: dict[str, tuple[int, int]]) -> None:
    """Passes on how often tasks have had each of these events, and the bytes of all."""
    for event in kinds:
        if event in counts:
            progress(event, n=counts[event][0], bytes=counts[event][1])


def create_archive(spark: SparkSession, inputs: list[str], target: str, config: Config | None = None, allow_empty: bool = False, progress: Progress = silent, event_log: str | None = None) -> CreateResult:
    """Packs the objects of all inputs into a tar archive, ordered by time.

    ``event_log`` is a folder for a Parquet table with one row for each event of an object or a part, as the tasks
    had it. ``progress`` gets these by kind once the tasks are done.
    """
    config, began = config or Config(), time.time()
    register(spark)
    store = config.store_options()
    check_path(spark, target, config)
    objects = gather(spark, inputs, allow_empty, store)
    check_plan(objects, allow_empty)
    check_keys(objects)
    index = archive_index(objects)
    total, plan = archive_totals(index).first(), totals(index).first()
    progress("archive_initialized", total_objects=plan.n_objects, total_bytes=plan.n_bytes, estimated_archive_size=plan.estimated_bytes)
    progress("input_objects_download_starting", total_objects=plan.n_objects, total_bytes=plan.n_bytes)
    whole = index.withColumns({"start": F.lit(0).cast("long"), "end": F.col("size")})
    rows = read_parts(whole, config.threshold, config.chunk).select("key", "size", "header_offset", "data_offset", "range_start", "range_end", "path")
    dealt = read_ranges(rows.repartitionByRange(F.col("header_offset"), F.col("range_start")).sortWithinPartitions("header_offset", "range_start"), store)
    log = event_log or (f"{checkpoint_dir(spark)}/events-{uuid.uuid4().hex}" if progress is not silent else None)
    options = store_options(store) | ({"events": log, "chunk": str(config.chunk)} if log else {})
    dealt.write.format("stowage-tar-writer").options(**options).mode("append").save(target)
    if log and plan.n_objects:
        counts = {r.event: (r.n, r.n_bytes) for r in event_summary(spark.read.schema(EVENTS).parquet(log)).collect()}
        tell(progress, CREATE_EVENTS, counts)
    progress("input_objects_download_completed", total_bytes=plan.n_bytes, seconds=time.time() - began)
    progress("archive_writes_completed", total_bytes_written=total.archive_bytes)
    if not is_mounted(target):
        progress("archive_bytes_uploaded", n=1, bytes=total.archive_bytes)
        progress("archive_upload_completed", size=total.archive_bytes, seconds=time.time() - began)
    return CreateResult(plan.n_objects, plan.n_bytes, total.archive_bytes, time.time() - began)


def list_archive(spark: SparkSession, source: str, filters: list[str] | None = None, all_types: bool = False, store: dict[str, str] | None = None) -> DataFrame:
    """The entries of an archive with ``included``."""
    register(spark)
    entries = spark.read.format("stowage-tar").options(allTypes=str(all_types).lower(), **store_options(store or {})).load(source)
    return marked(entries, [EntryFilter.parse(f) for f in filters or []])


def extract_archive(spark: SparkSession, source: str, target: str, filters: list[str] | None = None, config: Config | None = None, progress: Progress = silent, event_log: str | None = None, verify: bool = False) -> ExtractResult:
    """Writes the entries that any filter takes (all, if there is none) below the target; its prefix is put before the paths as it is.

    Headers are walked once, and only ranges of entries that are taken are read. On a mounted file system all
    tasks write ranges of all objects; other stores take an object from one task, which reads its ranges itself, so
    no data goes through a shuffle. ``verify`` reads what was written again and compares checksums.
    """
    config, began = config or Config(), time.time()
    register(spark)
    store = config.store_options()
    for path in (source, target):
        check_path(spark, path, config)
    where, name = filesystem(source, store)
    size = where.get_file_info(name).size
    progress("extract_starting", archive_size=size)
    checkpoint_dir(spark)
    entries = list_archive(spark, source, filters, store=store).checkpoint()
    counted = summary(entries).first()
    taken = entries.where("included").select("key", target_key(target).alias("target"), "size", "data_offset")
    ranges = read_parts(taken.withColumns({"start": F.lit(0).cast("long"), "end": F.col("size")}), config.threshold, config.chunk)
    rows = ranges.select("key", "target", "size", "data_offset", "part_number", "range_start", "range_end")
    log = event_log or f"{checkpoint_dir(spark)}/events-{uuid.uuid4().hex}"
    (_write_in_place if is_mounted(target) else _write_objects)(taken, rows, source, store).write.parquet(log)
    if verify:
        bad = _compared(rows, source, store).first()
        if bad:
            raise StowageError(f"{bad.target}: bytes from {bad.range_start} on are not those of the archive")
    if progress is not silent:
        counts = {r.event: (r.n, r.n_bytes) for r in event_summary(spark.read.schema(EVENTS).parquet(log)).collect()}
        if counted.skipped_objects:
            counts["extract_object_skipped"] = (counted.skipped_objects, counted.skipped_bytes)
        tell(progress, EXTRACT_EVENTS, counts)
    progress("extract_finished", extracted_objects=counted.extracted_objects, extracted_bytes=counted.extracted_bytes, skipped_objects=counted.skipped_objects, skipped_bytes=counted.skipped_bytes)
    progress("objects_uploaded", total_objects=counted.extracted_objects, total_object_bytes=counted.extracted_bytes, seconds=time.time() - began)
    return ExtractResult(counted.extracted_objects, counted.extracted_bytes, counted.skipped_objects, counted.skipped_bytes, time.time() - began)


EVENTS = "event string, key string, part_number int, bytes long"


def _events(rows: list[tuple]):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) or [[]] * 4
    types = (pa.string(), pa.string(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["event", "key", "part_number", "bytes"])


def _part_events(r: dict) -> list[tuple]:
    """What copying one part means for its object."""
    n, out = r["range_end"] - r["range_start"], []
    if r["range_start"] == 0:
        out += [(e, r["key"], None, r["size"]) for e in ("extract_object_starting", "object_upload_starting")]
    out += [(e, r["key"], r["part_number"], n) for e in ("extract_object_part_read", "object_part_uploaded")]
    if r["range_end"] == r["size"]:
        out += [(e, r["key"], None, r["size"]) for e in ("extract_object_finished", "object_uploaded")]
    return out


def _read(f, r: dict) -> bytes:
    f.seek(r["data_offset"] + r["range_start"])
    data = f.read(r["range_end"] - r["range_start"])
    if len(data) != r["range_end"] - r["range_start"]:
        raise CorruptArchive(f"{r['key']}: the archive ends inside its data")
    return data


def _write_in_place(taken: DataFrame, rows: DataFrame, source: str, store: dict[str, str]) -> DataFrame:
    """Creates all files in their full length, then copies ranges into them, in the order of the archive. Gives the events."""

    def create(part) -> None:
        for r in part:
            where, name = filesystem(r.target, store)
            where.create_dir(name.rpartition("/")[0] or "/", recursive=True)
            fd = os.open(name, os.O_CREAT | os.O_WRONLY, 0o644)
            try:
                os.ftruncate(fd, r.size)
            finally:
                os.close(fd)

    taken.select("target", "size").foreachPartition(create)

    def run(batches):
        with open_path(source, store) as f:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    data, done = _read(f, r), 0
                    try:  # never created here: the folder must be the same on all machines
                        fd = os.open(filesystem(r["target"], store)[1], os.O_WRONLY)
                    except FileNotFoundError as e:
                        raise StowageError(f"{r['target']}: not the same folder on all machines") from e
                    try:
                        while done < len(data):
                            done += os.pwrite(fd, memoryview(data)[done:], r["range_start"] + done)
                    finally:
                        os.close(fd)
                    out += _part_events(r)
                yield _events(out)

    return rows.repartitionByRange(F.col("data_offset"), F.col("range_start")).sortWithinPartitions("data_offset", "range_start").mapInArrow(run, EVENTS)


def _write_objects(taken: DataFrame, rows: DataFrame, source: str, store: dict[str, str]) -> DataFrame:
    """Each object is written by one task, which reads its ranges from the archive one at a time. Gives the events."""

    def run(batches):
        out, now, at = None, None, 0
        with open_path(source, store) as f:
            for batch in batches:
                told = []
                for r in batch.to_pylist():
                    if r["target"] != now or r["range_start"] == 0:
                        if out is not None:
                            out.close()
                        where, name = filesystem(r["target"], store)
                        out, now, at = where.open_output_stream(name), r["target"], 0
                    if r["range_start"] != at:
                        raise StowageError(f"{now}: a part is missing before byte {r['range_start']}")
                    out.write(_read(f, r))
                    at = r["range_end"]
                    told += _part_events(r)
                yield _events(told)
        if out is not None:
            out.close()

    return rows.repartition("target").sortWithinPartitions("target", "data_offset", "range_start").mapInArrow(run, EVENTS)


def _compared(rows: DataFrame, source: str, store: dict[str, str]) -> DataFrame:
    """Ranges whose SHA-256 is not that of the archive's bytes: ``target, range_start``."""
    import pyarrow as pa

    def run(batches):
        with open_path(source, store) as f:
            for batch in batches:
                bad = []
                for r in batch.to_pylist():
                    with open_path(r["target"], store) as g:
                        g.seek(r["range_start"])
                        own = g.read(r["range_end"] - r["range_start"])
                    if hashlib.sha256(own).digest() != hashlib.sha256(_read(f, r)).digest():
                        bad.append((r["target"], r["range_start"]))
                yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in bad], pa.string()), pa.array([b[1] for b in bad], pa.int64())], names=["target", "range_start"])

    return rows.mapInArrow(run, "target string, range_start long")
