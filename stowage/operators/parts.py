"""Byte-range parts of objects, and checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stowage.model import IDENTITY, MAX_OBJECT_SIZE, MAX_PARTS


def _ranges(df: DataFrame, start: Column, size: Column, chunk: Column, count: Column) -> DataFrame:
    """One row for each of ``count`` (at least one) ranges of ``chunk`` bytes from ``start``, the last one short."""
    rows = df.withColumns({"_start": start.cast("long"), "_size": size.cast("long"), "_chunk": chunk.cast("long"), "_count": F.greatest(count, F.lit(1)).cast("int")})
    rows = rows.withColumn("part_number", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    begin = F.col("_start") + F.col("part_number").cast("long") * F.col("_chunk")
    end = F.when(F.col("part_number") == F.col("_count") - 1, F.col("_start") + F.col("_size")).otherwise(begin + F.col("_chunk"))
    return rows.withColumns({"range_start": begin, "range_end": end}).drop("_start", "_size", "_chunk", "_count")


def _chunks(size: str, chunk: int) -> Column:
    """Whole division of a column rounded up, in integers."""
    return F.expr(f"({size} + {chunk - 1}) div {chunk}")


def object_parts(objects: DataFrame, threshold: int, chunk: int) -> DataFrame:
    """Download parts. An object smaller than the threshold is one part, at the threshold it is cut; an empty one is one empty part."""
    count = F.when(F.col("size") < threshold, F.lit(1)).otherwise(_chunks("size", chunk))
    return _ranges(objects, F.lit(0), F.col("size"), F.lit(chunk), count).select(*IDENTITY, F.col("size").alias("object_size"), "part_number", "range_start", "range_end")


def read_parts(ranges: DataFrame, threshold: int, chunk: int) -> DataFrame:
    """Parts of byte ranges (``start``, ``end``) of objects, beginning at the start of each range."""
    sized = ranges.withColumn("_length", F.col("end") - F.col("start"))
    count = F.when(F.col("_length") < threshold, F.lit(1)).otherwise(_chunks("_length", chunk))
    return _ranges(sized, F.col("start"), F.col("_length"), F.lit(chunk), count).drop("_length")


def upload_parts(objects: DataFrame, threshold: int, chunk: int) -> DataFrame:
    """Upload parts, numbered from 1, of objects larger than the threshold; others are put whole and have none."""
    large = objects.where(F.col("size") > threshold)
    parts = _ranges(large, F.lit(0), F.col("size"), F.lit(chunk), _chunks("size", chunk))
    return parts.select(*IDENTITY, F.col("size").alias("object_size"), (F.col("part_number") + 1).alias("part_number"), "range_start", "range_end")


def upload_strategy(sizes: DataFrame, threshold: int, chunk: int) -> DataFrame:
    """Adds ``strategy`` and ``chunk_size`` for a size hint: unknown sizes use the configured chunk, large ones one that stays within the limit of parts."""
    size = F.col("size_hint")
    many = F.expr(f"(size_hint + {chunk - 1}) div {chunk}") > MAX_PARTS
    wide = F.expr(f"(size_hint + {MAX_PARTS - 1}) div {MAX_PARTS}")
    strategy = F.when(size.isNull(), "multipart").when(size > MAX_OBJECT_SIZE, "too_large").when(size <= threshold, "single").otherwise("multipart")
    used = F.when(size.isNull(), F.lit(chunk)).when((size > MAX_OBJECT_SIZE) | (size <= threshold), F.lit(None)).when(many, wide).otherwise(F.lit(chunk))
    return sizes.withColumns({"strategy": strategy, "chunk_size": used.cast("long")})


def contiguity(parts: DataFrame, keys: list[str] = IDENTITY) -> DataFrame:
    """``n_parts, n_gaps, starts_at_zero, ends_at_size, contiguous`` for every object."""
    w = W.partitionBy(*keys).orderBy("part_number")
    gap = (F.lag("range_end").over(w) != F.col("range_start")) | (F.lag("part_number").over(w) + 1 != F.col("part_number"))
    marked = parts.withColumn("gap", F.coalesce(gap, F.lit(False)))
    out = marked.groupBy(*keys).agg(
        F.count("*").alias("n_parts"),
        F.count_if("gap").alias("n_gaps"),
        (F.min("range_start") == 0).alias("starts_at_zero"),
        (F.max("range_end") == F.max("object_size")).alias("ends_at_size"),
    )
    return out.withColumn("contiguous", (F.col("n_gaps") == 0) & F.col("starts_at_zero") & F.col("ends_at_size"))


def completeness(done: DataFrame, expected: DataFrame, keys: list[str] = IDENTITY) -> DataFrame:
    """Planned parts and those of them that were finished, each once, for every object.

    64 part numbers are a mask, which is combined where the parts are: a row for each mask is shuffled, none for a part.
    """
    number, one = F.col("part_number"), F.lit(1).cast("long")
    bit = F.call_function("shiftleft", one, F.expr("cast(part_number & 63 as int)"))
    masks = lambda df, side: df.select(*keys, F.shiftright(number, 6).alias("_block"), F.lit(side).alias("_done"), bit.alias("_bit"))
    every = masks(expected, False).unionByName(masks(done, True))
    side = lambda x: F.coalesce(F.bit_or(F.when(F.col("_done") == x, F.col("_bit"))), F.lit(0).cast("long"))
    by = every.groupBy(*keys, "_block").agg(F.count_if(~F.col("_done")).alias("_n"), F.bit_count(side(False).bitwiseAND(side(True))).alias("_both"))
    out = by.groupBy(*keys).agg(F.sum("_n").alias("n_expected"), F.sum("_both").cast("long").alias("n_done")).where("n_expected > 0")
    return out.withColumn("complete", F.col("n_done") == F.col("n_expected"))


def lifecycle(parts: DataFrame) -> DataFrame:
    """Marks the first part (number 0) and the last (its end is the object's) of every object."""
    return parts.withColumns({"is_first": F.col("part_number") == 0, "is_last": F.col("range_end") == F.col("object_size")})


def part_totals(parts: DataFrame) -> DataFrame:
    return parts.agg(F.count("*").alias("n_parts"), F.coalesce(F.sum(F.col("range_end") - F.col("range_start")), F.lit(0)).cast("long").alias("n_bytes"))


def multipart_totals(parts: DataFrame, keys: list[str] = IDENTITY) -> DataFrame:
    """Parts and bytes of every object."""
    return parts.groupBy(*keys).agg(F.count("*").alias("n_parts"), F.sum(F.col("range_end") - F.col("range_start")).cast("long").alias("n_bytes"))


def archive_upload_parts(archive: DataFrame, chunk: int) -> DataFrame:
    """Parts of the archive itself, a stream cut into fixed chunks; ``archive`` has one row with ``archive_bytes``."""
    parts = _ranges(archive, F.lit(0), F.col("archive_bytes"), F.lit(chunk), _chunks("archive_bytes", chunk))
    return parts.select("part_number", "range_start", "range_end")
