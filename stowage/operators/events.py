"""Event logs of jobs: their summary and the invariants of a successful one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Events of the two kinds of job, in the order in which a job fires them; fixed values.
CREATE_EVENTS = (
    "input_objects_download_starting",
    "input_object_download_started",
    "input_part_unordered_downloaded",
    "input_part_downloaded",
    "input_object_download_completed",
    "input_objects_download_completed",
    "archive_initialized",
    "archive_part_written",
    "archive_object_written",
    "archive_bytes_written",
    "archive_writes_completed",
    "archive_bytes_uploaded",
    "archive_upload_completed",
)
EXTRACT_EVENTS = (
    "extract_starting",
    "extract_archive_part_read",
    "extract_object_skipped",
    "extract_object_starting",
    "extract_object_part_read",
    "extract_object_finished",
    "extract_finished",
    "object_upload_starting",
    "object_part_uploaded",
    "object_uploaded",
    "objects_uploaded",
)
#: Events that a job fires once at most.
ONCE = (
    "input_objects_download_starting",
    "input_objects_download_completed",
    "archive_initialized",
    "archive_writes_completed",
    "archive_upload_completed",
    "extract_starting",
    "extract_finished",
    "objects_uploaded",
)


def summary(events: DataFrame) -> DataFrame:
    """Number and bytes of every kind of event."""
    return events.groupBy("event").agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("n_bytes"))


def repeated(events: DataFrame, once: tuple[str, ...] = ONCE) -> DataFrame:
    """Events that a job fires at most once, but the log has more often."""
    return events.where(F.col("event").isin(*once)).groupBy("event").agg(F.count("*").alias("n")).where("n > 1")


def progress(events: DataFrame, sizes: DataFrame, keys: list[str], event: str = "object_part_uploaded") -> DataFrame:
    """Uploaded bytes of every object so far, part by part, with flags for running past its size and for its end."""
    w = W.partitionBy(*keys).orderBy("part_number").rowsBetween(W.unboundedPreceding, 0)
    parts = events.where(F.col("event") == event).withColumn("uploaded", F.sum("bytes").over(w).cast("long"))
    joined = parts.join(sizes, keys)
    return joined.select(*keys, "part_number", "bytes", "uploaded", "size", (F.col("uploaded") > F.col("size")).alias("exceeds"), (F.col("uploaded") == F.col("size")).alias("done"))


#: For each object: the event whose bytes are those of the other, and how the parts of an object add up to it.
BY_KEY = (
    ("input_object_download_started", "input_object_download_completed"),
    ("input_object_download_completed", "archive_object_written"),
    ("input_object_download_completed", "input_part_downloaded"),
    ("input_part_unordered_downloaded", "input_part_downloaded"),
    ("input_part_downloaded", "archive_part_written"),
    ("extract_object_starting", "extract_object_finished"),
    ("extract_object_finished", "extract_object_part_read"),
    ("object_upload_starting", "object_uploaded"),
    ("object_uploaded", "object_part_uploaded"),
)


def mismatched(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``key, left_event, right_event, left_bytes, right_bytes``: objects whose bytes differ between two events that should agree, or that lack one."""
    keys = keys or ["key"]
    names = sorted({e for pair in BY_KEY for e in pair})
    sums = events.where(F.col("event").isin(*names)).groupBy(*keys).agg(*(F.sum(F.when(F.col("event") == e, F.col("bytes"))).alias(e) for e in names))
    pairs = F.array(*(F.struct(F.lit(a).alias("left_event"), F.lit(b).alias("right_event"), F.col(a).cast("long").alias("left_bytes"), F.col(b).cast("long").alias("right_bytes")) for a, b in BY_KEY))
    return sums.select(*keys, F.inline(pairs)).where(~F.col("left_bytes").eqNullSafe(F.col("right_bytes")))


def create_log(index: DataFrame, parts: DataFrame) -> DataFrame:
    """The log of a successful create job, derived from its plan: ``event, bucket, key, version_id, part_number, bytes``.

    Every object and every part is read once and exploded into its events.
    """
    none = F.lit(None).cast("int")
    row = lambda event, number, n: F.struct(F.lit(event).alias("event"), number.alias("part_number"), n.cast("long").alias("bytes"))
    size, length, number = F.col("size"), F.col("range_end") - F.col("range_start"), F.col("part_number").cast("int")
    ids = ["bucket", "key", "version_id"]
    whole = ("input_object_download_started", "input_object_download_completed", "archive_object_written")
    objects = index.select(*ids, F.inline(F.array(*(row(e, none, size) for e in whole), row("archive_bytes_written", none, F.col("entry_len")))))
    pieces = parts.select(*ids, F.inline(F.array(*(row(e, number, length) for e in ("input_part_unordered_downloaded", "input_part_downloaded", "archive_part_written")))))
    return objects.unionByName(pieces).select("event", *ids, "part_number", "bytes")


def extract_log(entries: DataFrame, pieces: DataFrame) -> DataFrame:
    """The log of a successful extract job: ``event, key, part_number, bytes``, from marked entries and the parts of those that are included."""
    none = F.lit(None).cast("int")
    row = lambda event, number, n: F.struct(F.lit(event).alias("event"), number.alias("part_number"), n.cast("long").alias("bytes"))
    size, length, number = F.col("size"), F.col("range_end") - F.col("range_start"), F.col("part_number").cast("int")
    yes = F.array(*(row(e, none, size) for e in ("extract_object_starting", "extract_object_finished", "object_upload_starting", "object_uploaded")))
    objects = entries.select("key", F.inline(F.when(F.col("included"), yes).otherwise(F.array(row("extract_object_skipped", none, size)))))
    read = pieces.select("key", F.inline(F.array(*(row(e, number, length) for e in ("extract_object_part_read", "object_part_uploaded")))))
    return objects.unionByName(read).select("event", "key", "part_number", "bytes")


#: Pairs of events whose bytes agree in every successful job; those of whole objects agree in number too.
EQUAL = (
    ("input_object_download_started", "input_object_download_completed"),
    ("input_part_unordered_downloaded", "input_part_downloaded"),
    ("archive_object_written", "input_object_download_completed"),
    ("archive_part_written", "input_part_downloaded"),
    ("extract_object_starting", "extract_object_finished"),
    ("extract_object_finished", "object_upload_starting"),
    ("object_upload_starting", "object_uploaded"),
)
#: Pairs of which the second has more bytes, if there is anything.
MORE = (("archive_object_written", "archive_bytes_written"),)


def reconcile(events: DataFrame) -> DataFrame:
    """``invariant, left_n, right_n, left_bytes, right_bytes, holds`` for every invariant; one pass over the log, whose summary has a row for each kind of event."""
    names = sorted({e for pair in (*EQUAL, *MORE) for e in pair})
    aggs = []
    for e in names:
        own = lambda c, e=e: F.coalesce(F.sum(F.when(F.col("event") == e, F.col(c))), F.lit(0)).cast("long")
        aggs += [own("n").alias(f"n_{e}"), own("n_bytes").alias(f"b_{e}")]
    rows = []
    for pairs, sign in ((EQUAL, "="), (MORE, "<")):
        for a, b in pairs:
            holds = (F.col(f"n_{a}") == F.col(f"n_{b}")) & (F.col(f"b_{a}") == F.col(f"b_{b}")) if sign == "=" else (F.col(f"b_{a}") < F.col(f"b_{b}")) | (F.col(f"n_{a}") == 0)
            rows.append(F.struct(F.lit(f"{a} {sign} {b}").alias("invariant"), F.col(f"n_{a}").alias("left_n"), F.col(f"n_{b}").alias("right_n"), F.col(f"b_{a}").alias("left_bytes"), F.col(f"b_{b}").alias("right_bytes"), holds.alias("holds")))
    return summary(events).agg(*aggs).select(F.inline(F.array(*rows)))
