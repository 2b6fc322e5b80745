"""The byte layout of an archive, from metadata alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.model import ARCHIVE_ORDER, TAR_BLOCK, TAR_NAME, InvalidKey
from stowage.plans.scale import ordered_sums


def padded(n: Column) -> Column:
    """A length rounded up to whole blocks."""
    return F.ceil(n / TAR_BLOCK).cast("long") * TAR_BLOCK


def header_length(key: Column) -> Column:
    """A path that fits the name field takes one block; a longer one an entry of its own before it."""
    n = F.octet_length(key).cast("long")
    return F.when(n <= TAR_NAME, F.lit(TAR_BLOCK).cast("long")).otherwise(2 * TAR_BLOCK + padded(n + 1))


def entry_columns(objects: DataFrame) -> DataFrame:
    """Adds ``header_len, data_len, pad_len, entry_len``."""
    size = F.col("size")
    pad = F.pmod(TAR_BLOCK - size % TAR_BLOCK, F.lit(TAR_BLOCK)).cast("long")
    return objects.withColumns({"header_len": header_length(F.col("key")), "data_len": size, "pad_len": pad}).withColumn("entry_len", F.col("header_len") + F.col("data_len") + F.col("pad_len"))


def archive_index(objects: DataFrame) -> DataFrame:
    """Adds position, lengths, ``header_offset`` and ``data_offset`` of every object's entry."""
    placed = ordered_sums(entry_columns(objects), ARCHIVE_ORDER, {"header_offset": "entry_len"}, "position")
    return placed.withColumn("data_offset", F.col("header_offset") + F.col("header_len"))


def archive_totals(objects: DataFrame) -> DataFrame:
    """``n_entries, data_bytes, entry_bytes, archive_bytes``: an archive ends in two empty blocks."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return entry_columns(objects).agg(F.count("*").alias("n_entries"), total("data_len").alias("data_bytes"), total("entry_len").alias("entry_bytes"), (total("entry_len") + 2 * TAR_BLOCK).alias("archive_bytes"))


def bad_keys(objects: DataFrame) -> DataFrame:
    """Objects whose keys cannot be paths in an archive: empty, absolute, or with a parent component."""
    return objects.where((F.col("key") == "") | F.col("key").startswith("/") | F.col("key").rlike(r"(^|/)\.\.(/|$)"))


def check_keys(objects: DataFrame) -> None:
    """Raises on the first such key."""
    row = bad_keys(objects).select("key").first()
    if row:
        raise InvalidKey(f"no path in an archive: {row.key!r}")
