"""Object catalogs over plain tables: what the registered queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.sources.catalog import as_objects

#: Buckets of the catalog, each over the table of its name.
BUCKETS = ("documents", "pages", "events", "orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def after_epoch(seconds: Column) -> Column:
    """A time so many seconds after the start of 2024."""
    return F.timestamp_seconds(F.lit(1_704_067_200) + seconds)


def byte_length(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0))


def document_key() -> Column:
    return F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id"), F.lit(".txt")))


def bucket(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The objects of one bucket. Texts count with their UTF-8 bytes; many objects share a time."""
    rows = table(spark, sf_dir, name)
    if name == "documents":
        return as_objects(rows, name, document_key(), byte_length("text"), after_epoch(F.col("doc_id") % 97))
    if name == "pages":
        return as_objects(rows, name, F.concat("page_id", F.lit(".html")), byte_length("html"), after_epoch(F.col("page_id")))
    if name == "events":
        return as_objects(rows, name, F.concat_ws("/", "event_type", "user_id", F.concat("event_id", F.lit(".json"))), byte_length("props"), F.col("ts"))
    return as_objects(rows, "orders", F.concat_ws("/", "o_orderstatus", "o_orderpriority", "o_orderkey"), F.floor("o_totalprice"), F.col("o_orderdate"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of all buckets."""
    first, *others = (bucket(spark, sf_dir, name) for name in BUCKETS)
    for other in others:
        first = first.unionByName(other)
    return first


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of which many are there several times, with other sizes and times."""
    return as_objects(table(spark, sf_dir, "lineitem"), "lineitem", F.concat_ws("/", "l_orderkey", "l_linenumber"), F.floor("l_extendedprice"), F.col("l_shipdate"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current versions of two thirds of the documents."""
    rows = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0")
    return rows.select(F.lit("documents").alias("bucket"), document_key().alias("key"), F.concat(F.lit("v"), F.col("doc_id") % 5).alias("version_id"))
