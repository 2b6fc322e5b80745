"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that jobs inside an operator hand to Python at once.
ARROW_ROWS = 1024
#: A key is hot if it has more than one in this many of all rows: there are at most so many of them.
HOT = 1000
#: Buckets that the rows of a hot key are dealt to.
SALTS = 64
#: Marks of a sieve, which broadcasts a bit for each.
MARKS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Makes sure that checkpoints have a folder: the one in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder takes its place, but only in local
    mode: executors of a cluster wouldn't find each other's files there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stowage-"))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs of this block hand at most ``ARROW_ROWS`` rows at once to Python; the session's setting is as before afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= ARROW_ROWS:
        yield
        return
    spark.conf.set(key, str(ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from the shared checkpoint folder."""
    prepare(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, for a table that outlives its query's plan."""
    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The same rows, written as Parquet and read again."""
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, name: str) -> str:
    """A name for a column that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def sieve(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows whose key may be on the right: a filter with one hash function, for the join that follows.

    At most ``MARKS`` marks are broadcast, as bits of ``MARKS`` / 64 rows, however many keys there are; with far more keys than
    marks it lets everything through, and the join does all the work. A row for each mark would be 42 MB of the driver's memory, for each sieve.
    """
    mark = F.pmod(F.xxhash64(key), F.lit(MARKS))
    word, bit = F.shiftright(mark, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (mark % 64).cast("int"))
    bits = right.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    there = (F.col("_at") == F.col("_word")) & (F.col("_bit").bitwiseAND(F.col("_bits")) != 0)
    return left.withColumns({"_at": word, "_bit": bit}).join(F.broadcast(bits), there, "left_semi").drop("_at", "_bit")


def small(df: DataFrame, rows: int = MARKS) -> DataFrame:
    """The same rows, computed once, to be broadcast in a join if they are no more than ``rows``; else the join shuffles."""
    done = cut(df)
    return F.broadcast(done) if done.limit(rows + 1).count() <= rows else done


def hot_join(left: DataFrame, right: DataFrame, key: str, by: str, total: int, on: list[str] | None = None) -> DataFrame:
    """Inner join on ``key`` (and ``on``) that deals the left rows of hot keys to ``SALTS`` buckets each.

    ``right`` is small, computed already, and has ``n``, the number of left rows of its key;
    ``total`` is the sum of n. Keys with more than total / HOT rows are at most HOT, so
    they are broadcast; only their rows on the right are repeated, once for each bucket.
    The left column ``by`` tells the bucket.
    """
    hot = right.where(F.col("n") * HOT > total).select(key).distinct().withColumn("_hot", F.lit(True))
    bucket = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot"), bucket).otherwise(0)).drop("_hot")
    every = F.when(F.col("n") * HOT > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("_salt", F.explode(every)).drop("n"), [key, *(on or []), "_salt"]).drop("_salt")


def key_join(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """The rows of ``hot_join`` where ``right`` has one row for each key: those of hot keys, at most HOT, are broadcast.

    Left rows of hot keys stay where they are. The join is on ``key`` alone, whether or not there are hot keys.
    """
    hot = [r[0] for r in right.where(F.col("n") * HOT > total).select(key).collect()]
    right = right.drop("n")
    if not hot:
        return left.join(right, key)
    own = F.col(key).isin(hot)
    return left.where(~own).join(right.where(~own), key).union(left.where(own).join(F.broadcast(right.where(own)), key))


def pair_blocks(df: DataFrame, member: str, blocks: str, minor: str | None = None, minor_blocks: str | None = None) -> DataFrame:
    """Replicates the rows of large groups so that every two rows of a group meet in one bounded cell.

    ``blocks`` names the column with the number of blocks of the row's group.
    A row gets a block from the hash of ``member`` and is sent to each pair of
    blocks with its own. Adds ``bi`` <= ``bj`` (the cell) and ``mine`` (the row's
    block); one block means one cell and no replication.

    Where rows are ``minor`` or not, the first ``minor_blocks`` blocks are for those that are,
    and two others need not meet: they are sent to the cells with minor blocks only.
    """
    number = F.xxhash64(F.col(member))
    own, reach = F.pmod(number, F.col(blocks)), F.col(blocks)
    if minor:
        few = F.col(minor_blocks)
        own = F.when(F.col(minor), F.pmod(number, few)).otherwise(few + F.pmod(number, F.col(blocks) - few))
        reach = F.when(F.col(minor), F.col(blocks)).otherwise(few)
    return (
        df.withColumn("mine", own.cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), reach.cast("int") - 1)))
        .withColumn("bi", F.least("mine", "other"))
        .withColumn("bj", F.greatest("mine", "other"))
        .drop("other", blocks)
    )


def by_group(df: DataFrame, keys: list[str], fn: Callable[[tuple, pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Runs ``fn`` over each group of ``keys``, streaming through sorted partitions.

    It is a grouped map without a pandas frame for each group: callers bound
    the size of groups (see ``pair_blocks``), and a task holds one at a time.
    """
    dealt = df.repartition(*keys).sortWithinPartitions(*keys)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)]
            new = np.zeros(batch.num_rows, bool)
            for x in cols:
                new[1:] |= x[1:] != x[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                this = tuple(x[start] for x in cols)
                if key is not None and this != key:
                    out = fn(key, pa.Table.from_batches(held))
                    if out is not None and out.num_rows:
                        yield out
                    held = []
                key = this
                held.append(batch.slice(start, stop - start))
        if held:
            out = fn(key, pa.Table.from_batches(held))
            if out is not None and out.num_rows:
                yield out

    cols = [*keys, *(c for c in dealt.columns if c not in keys)]
    return dealt.select(*cols).mapInArrow(run, schema)
