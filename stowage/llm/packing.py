"""Packing into optimal length buckets.

Lengths are tokens, counted exactly by ``bpe``. Every document's length is rounded up to a bucket boundary when it is padded.
Dynamic programming over the histogram of all lengths chooses at most
``n_buckets`` boundaries with the least padding in total; batches of at most a token budget,
padding included, are then formed inside each bucket.

The histogram has a row for each length that occurs: their number is at most the root of twice all
tokens. Padding satisfies the quadrangle inequality, so the best last boundary grows with the
length and a level of the programme takes n log n steps; boundaries are the best for all
lengths. Ranks inside a bucket come from counts of bounded chunks, not from one window over the bucket.

Edge cases. Null, empty and blank texts have no tokens and take part with
length 0. A document longer than the budget is a batch of its own. Equal
lengths are told apart by doc_id; rows that share a doc_id, and rows without one, are
documents of their own in any order. Very long texts are counted whole. An empty table gives an
empty result. Extra columns are ignored, also those with names of the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import Many, count_tokens, tokenizer_file
from .common import cut, table

BUCKETS, BUDGET, CHUNK = 16, 32_768, 2048


def _level(cost: np.ndarray, length: np.ndarray, docs: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One more bucket: the least padding of the first j lengths and where the last bucket begins, for all j."""
    n = len(length)
    new, src = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    stride = 1 << n.bit_length()
    while stride:
        # halfway between places that are known, whose beginnings bound these
        j = np.arange(stride, n + 1, 2 * stride)
        if len(j):
            lo = src[j - stride]
            hi = np.minimum(np.where(j + stride <= n, src[np.minimum(j + stride, n)], n), j - 1)
            amount = hi - lo + 1
            first = np.cumsum(amount) - amount
            i = np.repeat(lo - first, amount) + np.arange(amount.sum())
            k = np.repeat(j, amount)
            whole = cost[i] + length[k - 1] * (docs[k] - docs[i]) - (tokens[k] - tokens[i])
            new[j] = np.minimum.reduceat(whole, first)
            least = np.flatnonzero(whole == np.repeat(new[j], amount))
            src[j] = i[least[np.searchsorted(least, first)]]
        stride >>= 1
    return new, src


def boundaries(length: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Bucket lengths with the least padding, for distinct lengths in order and their numbers of documents."""
    n = len(length)
    if not n:
        return []
    docs, tokens = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(length * count)])
    cost, back = np.concatenate([[0], length * docs[1:] - tokens[1:]]), [np.zeros(n + 1, np.int64)]
    while len(back) < buckets and cost[n]:
        cost, src = _level(cost, length, docs, tokens)
        back.append(src)
    out, j = [], n
    for src in reversed(back):
        if j == 0:
            break
        out.append(int(length[j - 1]))
        j = int(src[j])
    return sorted(set(out))


def pack(docs: DataFrame, n_buckets: int = BUCKETS, budget: int = BUDGET, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, bucket, bucket_length, batch, slot, padding`` for every document.

    ``batch`` counts from 0 inside a bucket, ``slot`` inside a batch. ``tokenizer`` is the content
    of a tokenizer's file, by default that of ``bpe.TOKENIZER``.
    """
    # rows get numbers, so that those without an id, or with the same one, are dealt to chunks like others
    counted = count_tokens(docs.select("doc_id", "text"), tokenizer or tokenizer_file(), counter=Many).select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("row"))
    sizes = cut(counted)
    histogram = sizes.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow().sort_by("n_tokens")
    length, count = (histogram[c].to_numpy().astype(np.int64) for c in ("n_tokens", "n"))
    bounds = boundaries(length, count, n_buckets) or [0]
    which = np.searchsorted(bounds, length) if len(length) else np.empty(0, np.int64)
    chunks = [max(1, -(-int(count[which == b].sum()) // CHUNK)) for b in range(len(bounds))]
    bucket = sum(((F.col("n_tokens") > b).cast("int") for b in bounds[:-1]), F.lit(0))
    at = lambda values: F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.col("bucket") + 1).cast("long")
    placed = sizes.withColumn("bucket", bucket).withColumn("bucket_length", at(bounds)).withColumn("chunk", F.pmod(F.xxhash64("row"), at(chunks)))
    before = placed.groupBy("bucket", "chunk").agg(F.count("*").alias("n")).select("bucket", "chunk", (F.sum("n").over(W.partitionBy("bucket").orderBy("chunk")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("bucket", "chunk").orderBy("doc_id", "row")) - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1)))).cast("long")
    ranked = placed.withColumn("own", own).join(before, ["bucket", "chunk"]).withColumn("rank", F.col("own") + F.col("before")).withColumn("room", room)
    return ranked.select("doc_id", "n_tokens", "bucket", "bucket_length", F.expr("rank div room").alias("batch"), (F.col("rank") % F.col("room")).alias("slot"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"))


def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed by length."""
    return pack(table(spark, sf_dir, "documents"))
