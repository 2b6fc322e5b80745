"""Building blocks for plans whose rows have one global order."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stowage.model import StowageError


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; in local mode, a temporary one where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise StowageError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stowage-"))
    return sc.getCheckpointDir()


def ordered_sums(df: DataFrame, order: list[str], sums: dict[str, str], position: str) -> DataFrame:
    """Adds a global 0-based position and, for each ``name: column`` of sums, the sum over all rows before.

    Rows are range-partitioned by the order once and kept in the checkpoint
    folder, so that a lost task cannot deal them differently; sums inside a partition
    are windows over it, and what lies before a partition comes from one row for
    each partition. No task sees more than a partition.
    """
    checkpoint_dir(df.sparkSession)
    part = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    totals = part.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(c).cast("long").alias(f"_s_{n}") for n, c in sums.items()))
    across = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("_part", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"), *(F.coalesce(F.sum(f"_s_{n}").over(across), F.lit(0)).alias(f"_b_{n}") for n in sums))
    own = W.partitionBy("_part").orderBy(*order)
    prior = own.rowsBetween(W.unboundedPreceding, -1)
    rows = part.withColumns({position: F.row_number().over(own) - 1} | {n: F.coalesce(F.sum(c).over(prior), F.lit(0)) for n, c in sums.items()})
    joined = rows.join(before, "_part")
    return joined.withColumns({position: (F.col(position) + F.col("_before")).cast("long")} | {n: (F.col(n) + F.col(f"_b_{n}")).cast("long") for n in sums}).select(*df.columns, position, *sums)
