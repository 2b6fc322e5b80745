"""Catalogs: DataFrames of objects from tables, file listings and version lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions.selectors import Selector
from stowage.functions.urls import SCHEMES, parse_location
from stowage.model import UnsupportedStore
from stowage.sources.files import store_options
from stowage.sources.tar import register


def as_objects(df: DataFrame, bucket: str, key: Column, size: Column, timestamp: Column) -> DataFrame:
    """Objects of a bucket from any table."""
    return df.select(
        F.lit(bucket).alias("bucket"),
        key.alias("key"),
        F.lit(None).cast("string").alias("version_id"),
        size.cast("long").alias("size"),
        timestamp.cast("timestamp").alias("timestamp"),
    )


def bucket_of(url: str) -> tuple[str, str]:
    """Where the objects of a bucket URL or a folder are, and the bucket's name."""
    scheme = url.split("://", 1)[0] if "://" in url else ""
    if scheme in SCHEMES:
        name = parse_location(url).bucket
        return f"{scheme}://{name}", name
    if scheme not in ("", "file"):
        raise UnsupportedStore(f"{url}: unsupported object store {scheme!r}")
    return url.rstrip("/"), url.rstrip("/").rsplit("/", 1)[-1]


def list_bucket(spark: SparkSession, url: str, selector: Selector | None = None, store: dict[str, str] | None = None) -> DataFrame:
    """Objects of a bucket or below a folder, with the ``path`` of each; contents are not read.

    A selector narrows the listing itself: a single object is looked up, a prefix is one folder, and a glob
    begins at its literal prefix.
    """
    register(spark)
    root, bucket = bucket_of(url)
    selector = selector or Selector("bucket")
    files = spark.read.format("stowage-listing").options(**selector.scope(), **store_options(store or {})).load(root).where(selector.predicate())
    return files.select(F.lit(bucket).alias("bucket"), "key", F.lit(None).cast("string").alias("version_id"), "size", "timestamp", "path")


def with_versions(objects: DataFrame, versions: DataFrame, versioning: bool = True) -> DataFrame:
    """Current versions of listed keys; without versioning there is no lookup and no version."""
    if not versioning:
        return objects.withColumn("version_id", F.lit(None).cast("string"))
    current = versions.select("bucket", "key", F.col("version_id").alias("current"))
    return objects.join(current, ["bucket", "key"], "left").withColumn("version_id", F.col("current")).select(*objects.columns)
