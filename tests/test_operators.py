"""Plans, parts, events and checks on edge cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stowage.model import InvalidFilter
from stowage.operators import events as log
from stowage.operators import extract, parts, verify
from stowage.plans import create, index
from stowage.plans.scale import ordered_sums

T0 = dt.datetime(2024, 1, 1)
OBJECTS = "bucket string, key string, version_id string, size long, timestamp timestamp"


def objects(spark, rows):
    return spark.createDataFrame([(b, k, v, n, T0 + dt.timedelta(seconds=t)) for b, k, v, n, t in rows], OBJECTS)


def test_dedupe_takes_missing_versions_as_equal(spark):
    df = objects(spark, [("b", "k", None, 5, 9), ("b", "k", None, 7, 3), ("b", "k", "v1", 1, 0), ("c", "k", None, 2, 0)])
    for fn in (create.dedupe,):
        assert sorted((r.bucket, r.version_id or "", r["size"]) for r in fn(df).collect()) == [("b", "", 7), ("b", "v1", 1), ("c", "", 2)]


def test_order_breaks_ties_by_identity(spark):
    df = objects(spark, [("b", "z", None, 1, 0), ("b", "a", None, 1, 0), ("a", "m", None, 1, 0), ("b", "b", "v", 1, -5)])
    assert [r.key for r in create.in_order(df).orderBy("position").collect()] == ["b", "m", "a", "z"]


def test_empty_tables(spark):
    none = objects(spark, [])
    assert create.totals(none).first().asDict() == {"n_objects": 0, "n_bytes": 0, "estimated_bytes": 0}
    assert index.archive_index(none).count() == 0
    assert index.archive_totals(none).first().archive_bytes == 1024
    assert parts.object_parts(none, 10, 10).count() == 0
    assert parts.part_totals(parts.object_parts(none, 10, 10)).first().n_bytes == 0
    assert all(r.n_left == 0 if "n_left" in r else r.holds for r in log.reconcile(log.create_log(index.entry_columns(none), parts.object_parts(none, 10, 10)).select("event", "bytes")).collect())


@pytest.mark.parametrize(("size", "download", "upload"), [(0, [(0, 0)], []), (9, [(0, 9)], []), (10, [(0, 4), (4, 8), (8, 10)], []), (11, [(0, 4), (4, 8), (8, 11)], [(0, 4), (4, 8), (8, 11)]), (12, [(0, 4), (4, 8), (8, 12)], [(0, 4), (4, 8), (8, 12)])])
def test_parts_at_the_threshold(spark, size, download, upload):
    df = objects(spark, [("b", "k", None, size, 0)])
    ranges = lambda d: [(r.range_start, r.range_end) for r in d.orderBy("part_number").collect()]
    assert ranges(parts.object_parts(df, 10, 4)) == download
    assert ranges(parts.upload_parts(df, 10, 4)) == upload


def test_empty_object_with_threshold_zero_is_one_part(spark):
    assert parts.object_parts(objects(spark, [("b", "k", None, 0, 0)]), 0, 4).count() == 1


def test_ranges_begin_at_their_start(spark):
    df = spark.createDataFrame([("k", 100, 110)], "key string, start long, end long")
    assert [(r.range_start, r.range_end) for r in parts.read_parts(df, 5, 4).orderBy("part_number").collect()] == [(100, 104), (104, 108), (108, 110)]


def test_broken_parts_are_found(spark):
    df = parts.object_parts(objects(spark, [("b", "whole", None, 20, 0), ("b", "gap", None, 20, 0), ("b", "short", None, 20, 0)]), 10, 4)
    df = df.where("not (key = 'gap' and part_number = 2) and not (key = 'short' and part_number = 4)")
    rows = {r.key: r for r in parts.contiguity(df).collect()}
    assert rows["whole"].contiguous
    assert (rows["gap"].contiguous, rows["gap"].n_gaps) == (False, 1)
    assert (rows["short"].contiguous, rows["short"].ends_at_size) == (False, False)


def test_upload_strategy_stays_within_the_limits_of_stores(spark):
    sizes = [None, 1, 8 << 20, (8 << 20) + 1, (8 << 20) * 10_000, (8 << 20) * 10_000 + 1, 5 << 40, (5 << 40) + 1]
    df = parts.upload_strategy(spark.createDataFrame([(s,) for s in sizes], "size_hint long"), 8 << 20, 8 << 20)
    got = {r.size_hint: (r.strategy, r.chunk_size) for r in df.collect()}
    assert got[None] == ("multipart", 8 << 20)
    assert got[8 << 20] == ("single", None)
    assert got[(8 << 20) + 1] == ("multipart", 8 << 20)
    assert got[(8 << 20) * 10_000] == ("multipart", 8 << 20)
    assert got[(8 << 20) * 10_000 + 1] == ("multipart", (8 << 20) + 1)
    assert got[5 << 40][0] == "multipart"
    assert got[(5 << 40) + 1] == ("too_large", None)


def test_sums_in_order_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("o"), (F.col("id") % 13).alias("n")).repartition(13)
    rows = ordered_sums(df, ["o"], {"before": "n"}, "position").orderBy("o").collect()
    total = 0
    for i, r in enumerate(rows):
        assert (r.position, r.before) == (i, total)
        total += r.n


def test_missing_extra_and_changed(spark):
    make = lambda rows: spark.createDataFrame(rows, "key string, sha256 string")
    got = verify.reconcile(make([("a", "1"), ("b", "2"), ("c", "3")]), make([("a", "1"), ("b", "x"), ("d", "4")])).collect()
    assert {r.key: r.status for r in got} == {"a": "ok", "b": "mismatch", "c": "missing", "d": "extra"}


def test_filter_tables(spark):
    entries = spark.createDataFrame([("a", 1), ("b/c", 2), ("b/d.txt", 3), ("b/x/y/z", 4), ("b/x", 5), ("bb/x/", 6), ("a", 7)], "key string, size long")
    table = lambda *rows: spark.createDataFrame([(r,) for r in rows], "value string")
    cases = [
        (("a", "b/*.txt", "b/*.txt"), [1, 3, 7]),
        (("b/", "b/x/"), [2, 3, 4, 5]),
        (("b/x/",), [4]),
        (("bb/",), [6]),
        (("**",), [1, 2, 3, 4, 5, 6, 7]),
        (("none",), []),
        ((), []),
    ]
    for filters, sizes in cases:
        assert sorted(r["size"] for r in extract.semi_join(entries, table(*filters)).collect()) == sizes
        assert sorted(r["size"] for r in extract.semi_join(entries, table(*filters), "left_anti").collect()) == sorted({1, 2, 3, 4, 5, 6, 7} - set(sizes))
    with pytest.raises(InvalidFilter):
        extract.semi_join(entries, table("a", "/"))


def test_invariants_of_a_damaged_log(spark):
    df = objects(spark, [("b", "k", None, 20, 0), ("b", "l", None, 3, 0)])
    whole = log.create_log(index.entry_columns(df), parts.object_parts(df, 10, 4))
    assert all(r.holds for r in log.reconcile(whole).collect())
    damaged = log.reconcile(whole.where("not (event = 'input_part_downloaded' and part_number = 1)")).collect()
    assert {r.invariant for r in damaged if not r.holds} == {"input_part_unordered_downloaded = input_part_downloaded", "archive_part_written = input_part_downloaded"}
    twice = whole.union(whole.where("event = 'input_object_download_started'")).selectExpr("'archive_initialized' as event")
    assert log.repeated(twice).first().n == twice.count()


def test_completeness_shuffles_no_parts(spark):
    """Parts go into masks of 64 before the shuffle; repeated ones, and some that nobody planned, count for nothing."""
    planned = spark.createDataFrame([("b", k, None, p) for k, n in (("long", 200), ("gap", 65), ("none", 1), ("other", 2)) for p in range(n)], "bucket string, key string, version_id string, part_number int")
    some = [("long", p) for p in range(200)] * 2 + [("gap", p) for p in range(65) if p != 63] + [("other", 0), ("other", 7), ("unknown", 0)]
    out = parts.completeness(spark.createDataFrame([("b", k, None, p) for k, p in some], planned.schema), planned)
    assert {r.key: (r.n_expected, r.n_done, r.complete) for r in out.collect()} == {"long": (200, 200, True), "gap": (65, 64, False), "none": (1, 0, False), "other": (2, 1, False)}
    dealt = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert dealt
    assert not any("part_number" in line for line in dealt)
