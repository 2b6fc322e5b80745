"""Expected against actual contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checksum(data: Column) -> Column:
    """SHA-256 as hexadecimal text."""
    return F.sha2(data.cast("binary"), 256)


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``key, status, expected_sha256, actual_sha256``: ok, missing, extra or mismatch, by one full outer join on the key."""
    e = expected.select("key", F.col("sha256").alias("expected_sha256"), F.lit(True).alias("_e"))
    a = actual.select("key", F.col("sha256").alias("actual_sha256"), F.lit(True).alias("_a"))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("expected_sha256") == F.col("actual_sha256"), "ok").otherwise("mismatch")
    return e.join(a, "key", "full_outer").select("key", status.alias("status"), "expected_sha256", "actual_sha256")
