"""Upload progress of objects over a stream of part events, and listings as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, n_parts long, uploaded long, size long, done boolean"


def _advance(idle: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # nothing came for too long: the upload was given up
            state.remove()
            return
        parts, uploaded, size = state.get if state.exists else (0, 0, None)
        for f in frames:
            own = f[f["event"] == "object_part_uploaded"]
            parts += len(own)
            uploaded += int(own["bytes"].sum())
            start = f.loc[f["event"] == "object_upload_starting", "bytes"]
            size = int(start.iloc[0]) if len(start) else size
        done = size is not None and uploaded >= size
        if done:
            state.remove()
        else:
            state.update((parts, uploaded, size))
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({"key": [key[0]], "n_parts": [parts], "uploaded": [uploaded], "size": pd.array([size], dtype="Int64"), "done": [done]})

    return run


def upload_progress(events: DataFrame, idle_hours: float = 24) -> DataFrame:
    """Parts and bytes of every object so far, from its start event and its part events in any order.

    ``events`` streams ``event, key, bytes``. The state of an object is three
    numbers and goes when all its bytes are there, or when nothing came for ``idle_hours``.
    """
    advance = _advance(int(idle_hours * 3_600_000))
    return events.select("event", "key", F.col("bytes").cast("long").alias("bytes")).groupBy("key").applyInPandasWithState(advance, OUT, "parts long, uploaded long, size long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def running_totals(events: DataFrame) -> DataFrame:
    """Number and bytes of every kind of event so far."""
    return events.groupBy("event").agg(F.count("*").alias("n"), F.sum("bytes").cast("long").alias("n_bytes"))


def watch_listing(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """New files under a directory as a stream of objects; Spark's file source leaves out empty ones and those whose names begin with a dot or an underscore."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).schema("path string, modificationTime timestamp, length long, content binary").load(root)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("timestamp"))
