"""The plan of an archive: which objects, once each, in which order."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions.selectors import Selector
from stowage.model import ARCHIVE_ORDER, IDENTITY, TAR_BLOCK, EmptyArchive, NothingMatched, ObjectNotFound
from stowage.plans.scale import ordered_sums


def union_inputs(objects: DataFrame, selectors: list[Selector]) -> DataFrame:
    """All inputs of one bucket as a bag: an object is there once for each input that selects it, with its ``ordinal``."""
    matched = F.array(*(F.when(s.predicate(), F.lit(i)) for i, s in enumerate(selectors)))
    return objects.where(reduce(or_, (s.predicate() for s in selectors))).withColumn("ordinal", F.explode(F.array_compact(matched)))


def select_any(objects: DataFrame, selectors: list[Selector]) -> DataFrame:
    """Objects that any input selects, in one scan: the predicates are or-ed, not the scans united."""
    return objects.where(reduce(or_, (s.predicate() for s in selectors)))


def dedupe(objects: DataFrame) -> DataFrame:
    """One row for each (bucket, key, version), the first in archive order; two missing versions are equal."""
    columns = [c for c in objects.columns if c not in IDENTITY]
    rest = F.min(F.struct("timestamp", *(c for c in columns if c != "timestamp"))).alias("first")
    return objects.groupBy(*IDENTITY).agg(rest).select(*(c if c in IDENTITY else F.col(f"first.{c}").alias(c) for c in objects.columns))


def match_counts(objects: DataFrame, selectors: list[Selector]) -> DataFrame:
    """``ordinal, kind, value, n_objects, n_bytes`` for every input, also those that match nothing; one pass over the objects."""
    counts = [F.count_if(s.predicate()).alias(f"n{i}") for i, s in enumerate(selectors)]
    sums = [F.coalesce(F.sum(F.when(s.predicate(), F.col("size"))), F.lit(0)).cast("long").alias(f"b{i}") for i, s in enumerate(selectors)]
    rows = [F.struct(F.lit(i).alias("ordinal"), F.lit(s.kind).alias("kind"), F.lit(s.value).cast("string").alias("value"), F.col(f"n{i}").alias("n_objects"), F.col(f"b{i}").alias("n_bytes")) for i, s in enumerate(selectors)]
    return objects.agg(*counts, *sums).select(F.inline(F.array(*rows)))


def check_inputs(objects: DataFrame, selectors: list[Selector], bucket: str, allow_empty: bool = False) -> None:
    """Raises if an input matches nothing. With ``allow_empty``, buckets and globs may; single objects and prefixes may not."""
    for row in match_counts(objects, selectors).collect():
        if row.n_objects == 0 and (not allow_empty or row.kind in ("object", "prefix")):
            raise (ObjectNotFound if row.kind == "object" else NothingMatched)(f"nothing matches: {selectors[row.ordinal].describe(bucket)}")


def check_plan(plan: DataFrame, allow_empty: bool = False) -> None:
    """Raises if the plan has no object."""
    if not allow_empty and plan.isEmpty():
        raise EmptyArchive("no object to archive")


def in_order(objects: DataFrame) -> DataFrame:
    """Adds ``position``, the 0-based place in the archive: by time, ties by bucket, key and version."""
    return ordered_sums(objects, ARCHIVE_ORDER, {}, "position")


def totals(plan: DataFrame) -> DataFrame:
    """``n_objects, n_bytes, estimated_bytes``; the estimate is a header for each object on top."""
    n, size = F.count("*"), F.coalesce(F.sum("size"), F.lit(0)).cast("long")
    return plan.agg(n.alias("n_objects"), size.alias("n_bytes"), (size + TAR_BLOCK * n).alias("estimated_bytes"))
