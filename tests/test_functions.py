"""Globs, selectors, filters, URLs, sizes and configuration."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from stowage.functions.globs import glob_to_regex, literal_prefix
from stowage.functions.selectors import EntryFilter, Selector, any_filter
from stowage.functions.sizes import format_size, parse_size
from stowage.functions.urls import parse_location
from stowage.model import Config, InvalidFilter, InvalidGlob, InvalidUrl, UnsupportedStore

TREE = ["readme", "ships/log.csv", "ships/tugs/log.csv", "ships/tugs/old/log.csv", "ports/list", "shipsize"]
NAMES = ["foo/test1.txt", "foo/test2.bin", "bar/test11.bin", "bar/test14.txt", "bar/deep/test15.txt", "a[b", "a]b", "ab", "ac", "a/c", "what?", "sp ace/ü.txt"]


def matched(spark, predicate, keys=TREE):
    return sorted(r.key for r in spark.createDataFrame([(k,) for k in keys], "key string").where(predicate).collect())


@pytest.mark.parametrize(
    ("text", "kind", "keys"),
    [
        (None, "bucket", TREE),
        ("", "bucket", TREE),
        ("readme", "object", ["readme"]),
        ("ships/tugs/log.csv", "object", ["ships/tugs/log.csv"]),
        ("ships/", "prefix", ["ships/log.csv"]),
        ("**", "glob", TREE),
        ("ships/**", "glob", ["ships/log.csv", "ships/tugs/log.csv", "ships/tugs/old/log.csv"]),
        ("ships/*/log.*", "glob", ["ships/tugs/log.csv"]),
        ("ships", "object", []),
    ],
)
def test_selectors(spark, text, kind, keys):
    s = Selector.parse(text)
    assert s.kind == kind
    assert matched(spark, s.predicate()) == sorted(keys)
    assert s.describe("b")


@pytest.mark.parametrize(
    ("pattern", "keys"),
    [
        ("**/*.txt", ["bar/deep/test15.txt", "bar/test14.txt", "foo/test1.txt", "sp ace/ü.txt"]),
        ("bar/*.bin", ["bar/test11.bin"]),
        ("bar/**/*.txt", ["bar/deep/test15.txt", "bar/test14.txt"]),
        ("a[bc]", ["ab", "ac"]),
        ("a[!b]", ["ac"]),
        ("a[.-z]c", []),
        ("a?c", []),
        ("a[[]b", ["a[b"]),
        ("a[]]b", ["a]b"]),
        ("a]b", ["a]b"]),
        ("what[?]", ["what?"]),
        ("sp ace/?.txt", ["sp ace/ü.txt"]),
        ("*", ["a[b", "a]b", "ab", "ac", "what?"]),
        ("[a-a][b-c]", ["ab", "ac"]),
    ],
)
def test_globs_in_spark_and_python(spark, pattern, keys):
    assert matched(spark, Selector.parse(pattern).predicate(), NAMES) == sorted(keys)
    regex = re.compile(glob_to_regex(pattern).removesuffix("$"))
    assert sorted(k for k in NAMES if regex.fullmatch(k)) == sorted(keys)


@pytest.mark.parametrize("pattern", ["a**", "**a", "***", "a[bc", "x/**y", "["])
def test_invalid_globs(pattern):
    with pytest.raises(InvalidGlob):
        glob_to_regex(pattern)


def test_newlines_and_prefixes(spark):
    assert matched(spark, Selector.parse("a*").predicate(), ["a\nb", "a\n", "b\na"]) == ["a\n", "a\nb"]
    assert literal_prefix("en/ü[ab]*") == "en/ü"
    assert literal_prefix("a]b") == "a"


def test_filters(spark):
    assert matched(spark, EntryFilter.parse("prefix3/").predicate()) == ["prefix3/prefix4/test", "prefix3/test"]
    assert matched(spark, any_filter([EntryFilter.parse("test"), EntryFilter.parse("prefix1/")])) == ["prefix1/test", "test"]
    assert matched(spark, any_filter([])) == sorted(TREE)
    for text in ("", "/"):
        with pytest.raises(InvalidFilter):
            EntryFilter.parse(text)
    assert EntryFilter.parse("/x").kind == "object"


def test_exact_filter_takes_no_longer_name(spark):
    names = [f"test{i}" for i in range(1, 21)]
    assert matched(spark, any_filter([EntryFilter.parse(x) for x in ("test1", "test5", "test9")]), names) == ["test1", "test5", "test9"]


def test_prefix_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("en/a",), ("fr/b",)], "key string").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(Selector.parse("en/*").predicate())._jdf.queryExecution().toString()
    assert "StringStartsWith(key,en/)" in plan


@pytest.mark.parametrize(("text", "n"), [("8MiB", 8 << 20), ("1KiB", 1024), ("10", 10), (7, 7), ("1.5 KiB", 1536), ("2kb", 2000), ("1 b", 1)])
def test_sizes(text, n):
    assert parse_size(text) == n


def test_bad_sizes():
    for text in ("", "x", "1 parsec", "-1"):
        with pytest.raises(ValueError, match="quantity"):
            parse_size(text)
    assert format_size(1536) == "1.50 KiB"
    assert format_size(3) == "3 B"


def test_locations():
    where = parse_location("s3://bucket/a/b")
    assert (where.bucket, where.key, where.version_id) == ("bucket", "a/b", None)
    assert parse_location("s3://bucket").key is None
    assert parse_location("s3://bucket/").key is None
    assert parse_location("s3://bucket//a").key == "/a"
    with pytest.raises(UnsupportedStore):
        parse_location("gs://bucket/a")
    with pytest.raises(InvalidUrl):
        parse_location("s3:///a")


def test_configuration():
    c = Config()
    assert (c.chunk, c.threshold, c.max_concurrent_requests) == (8 << 20, 8 << 20, 10)
    from stowage.cli import parser

    a = parser().parse_args(["create", "-f", "x", "s3://b"])
    assert (a.multipart_chunk_size, a.multipart_threshold, a.max_concurrent_requests) == (c.multipart_chunk_size, c.multipart_threshold, c.max_concurrent_requests)
    static = Config(access_key_id="a", secret_access_key="b", assume_role_arn="r").hadoop_conf()
    assert "spark.hadoop.fs.s3a.assumed.role.arn" not in static
    custom = Config(access_key_id="a", secret_access_key="b", credentials_provider="p").hadoop_conf()
    assert custom["spark.hadoop.fs.s3a.aws.credentials.provider"] == "p"
    assert "spark.hadoop.fs.s3a.access.key" not in custom


def test_kinds_of_columns_agree_with_those_of_texts(spark):
    from stowage.functions.selectors import filter_kind, input_kind

    texts = ["", "a", "a/", "a*", "a]", "?", "/", "/a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", input_kind(F.col("t")).alias("i"), filter_kind(F.col("t")).alias("f")).collect()
    for r in rows:
        if "]" in r.t or not any(c in r.t for c in "*?["):
            assert r.i == Selector.parse(r.t).kind
        assert r.f == (EntryFilter.parse(r.t).kind if r.t not in ("", "/") else "error")
