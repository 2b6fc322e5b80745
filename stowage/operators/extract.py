"""Entries of an archive: which are extracted, to where, in which pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.selectors import EntryFilter, any_filter, filter_kind


def marked(entries: DataFrame, filters: list[EntryFilter]) -> DataFrame:
    """Adds ``included``; entries that no filter takes stay, as they are counted."""
    return entries.withColumn("included", any_filter(filters))


def summary(entries: DataFrame) -> DataFrame:
    """Numbers and bytes of extracted and skipped entries."""
    n, total = lambda c: F.count_if(c), lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).cast("long")
    yes, no = F.col("included"), ~F.col("included")
    return entries.agg(n(yes).alias("extracted_objects"), total(yes).alias("extracted_bytes"), n(no).alias("skipped_objects"), total(no).alias("skipped_bytes"))


def target_key(prefix: str, key: Column | None = None) -> Column:
    """Where an entry goes: the prefix and the path, with nothing between."""
    return F.concat(F.lit(prefix), F.col("key") if key is None else key)


def names_of(key: Column) -> Column:
    """The key and the prefixes of all its folders: what an exact filter or a prefix has to equal."""
    steps = F.split(key, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")))
    return F.when(F.size(steps) > 1, F.concat(F.array(key), folders)).otherwise(F.array(key))


def semi_join(entries: DataFrame, filters: DataFrame, how: str = "left_semi") -> DataFrame:
    """Entries that any row of a filter table takes (``left_semi``) or none does (``left_anti``).

    ``filters`` has filters as text in ``value``. Exact keys and prefixes, of which there may be
    any number, are an equality join with the names of each key; globs, which are compiled
    on the driver, are one predicate.
    """
    kinds = filters.select("value", filter_kind(F.col("value")).alias("kind")).distinct()
    patterns = [EntryFilter.parse(r.value) for r in kinds.where("kind in ('glob', 'error')").collect()]
    names = kinds.where("kind in ('object', 'prefix')").select("value")
    named = entries.select("key", F.explode(names_of(F.col("key"))).alias("value")).join(names, "value", "left_semi").select("key").distinct()
    taken = F.coalesce("_named", F.lit(False)) | (any_filter(patterns) if patterns else F.lit(False))
    return entries.join(named.withColumn("_named", F.lit(True)), "key", "left").where(taken if how == "left_semi" else ~taken).select(*entries.columns)


def components(entries: DataFrame, threshold: int, chunk: int) -> DataFrame:
    """Small entries as one ``small`` row; larger ones as ``start``, a ``part`` for each chunk, and ``end``; ``seq`` gives the order."""
    n = F.expr(f"(size + {chunk - 1}) div {chunk}")
    piece = lambda kind, seq, a, b: F.struct(F.lit(kind).alias("component"), seq.cast("long").alias("seq"), a.cast("long").alias("range_start"), b.cast("long").alias("range_end"))
    zero, size = F.lit(0), F.col("size")
    parts = F.transform(F.sequence(zero.cast("long"), n - 1), lambda i: piece("part", i + 1, i * chunk, F.least((i + 1) * chunk, F.col("size"))))
    large = F.concat(F.array(piece("start", zero, zero, zero)), parts, F.array(piece("end", n + 1, size, size)))
    return entries.select("key", "size", F.inline(F.when(size < threshold, F.array(piece("small", zero, zero, size))).otherwise(large)))
