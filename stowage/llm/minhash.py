"""MinHash near-duplicates by an inverted join over signature coordinates.

Every document is posted under each pair (coordinate, minimum) of its
signature. Two documents whose word-shingle sets have Jaccard similarity J
share about J of the K pairs, so the search is for documents that share at
least T of them, with T four standard deviations below the mean at the
threshold. Only the documents that can reach T are kept (skip), and each of those is
listed under its K - T + 1 rarest pairs only (prefix): two documents with T
common pairs share one of those. Collisions of documents that share a list are counted,
half of the coordinates first, and exact similarities over full shingle sets confirm every
link (``setjoin``, which also tells how lists of any size are dealt).

Skew. Documents with equal shingle sets are one class from the start. Pairs that very many documents have
are dealt to buckets.

Edge cases. Null and empty texts have no shingles, link with nothing and are
kept. A text with fewer than five words is one shingle. A row without an id belongs to
the component of its text, and a component of such rows alone has no id. Texts that share an id
go each by their own component, repeated rows together. Very long texts are hashed in pieces. An
empty table gives an empty result. Extra columns are ignored, also those with names of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_join, key_join, prepare, sieve, small, table, unused
from .components import connected_components
from .setjoin import WIDTH, links
from .words import U, distinct, mix, rounds, shingle_hashes, strings, word_hashes

COORDINATES = 64


def match_threshold(similarity: float, coordinates: int = COORDINATES, deviations: float = 4.0) -> int:
    """Common coordinates that a pair at the similarity has, but for one pair in some 30,000."""
    mean, sd = similarity * coordinates, math.sqrt(similarity * (1 - similarity) * coordinates)
    return max(1, math.floor(mean - deviations * sd))


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20_08).integers(1, 2**63, n, dtype=np.uint64) | U(1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by = multipliers(COORDINATES)
    for batch in batches:
        data, offsets = strings(batch.column(1))
        for lo, hi in rounds(offsets):
            part = offsets[lo : hi + 1]
            hashes, amount = shingle_hashes(*word_hashes(data[part[0] : part[-1]], part - part[0]), WIDTH)
            n, at = hi - lo, 0
            sizes, prints = np.zeros(n, np.int64), np.zeros((n, 2), U)
            for i, k in enumerate(amount.tolist()):
                own = distinct(hashes[at : at + k])
                sizes[i] = len(own)
                prints[i] = mix(own).sum(), mix(own ^ U(0xA5A5A5A5A5A5A5A5)).sum()
                at += k
            full = np.flatnonzero(amount)
            signature = np.empty((len(full), COORDINATES), np.int32)
            if len(full):
                starts = (np.cumsum(amount) - amount)[full]
                for k in range(COORDINATES):
                    signature[:, k] = np.minimum.reduceat((hashes * by[k]) >> U(32), starts).astype(np.uint32).view(np.int32)
            ends = np.cumsum(np.where(amount > 0, COORDINATES, 0))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(lo, n) for c in (0, 2, 3, 4)), pa.array(sizes), pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(signature.ravel()))],
                names=["doc_id", "row", "k1", "k2", "n_shingles", "p1", "p2", "signature"],
            )


def prints(text: str = "text") -> list[Column]:
    """Two hashes that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def features(docs: DataFrame) -> DataFrame:
    """Set size, fingerprint of the set and signature of every document; ``k1, k2`` stand for its text, ``row`` for id and text."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), *prints()).mapInArrow(_features, "doc_id long, row long, k1 long, k2 long, n_shingles long, p1 long, p2 long, signature array<int>")


def prefixes(classes: DataFrame, need: int, total: int) -> DataFrame:
    """``list, member``: every class under its rarest posts, so many that two classes with ``need`` common ones share one."""
    posts = classes.select("member", F.posexplode("signature").alias("k", "x")).select("member", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("x").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("list"))
    common = cut(posts.groupBy("list").agg(F.count("*").alias("n")).where("n > 1").withColumn("df", F.col("n")))
    own = key_join(posts, common, "list", COORDINATES * total).groupBy("member").agg(F.collect_list(F.struct("df", "list")).alias("own"))
    # pairs that nobody else has come first in the prefix and need no list
    return own.where(F.size("own") >= need).select("member", F.explode(F.slice(F.sort_array("own"), 1, F.size("own") - (need - 1))).alias("p")).select(F.col("p.list").alias("list"), "member")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Documents link when 100 * |A & B| >= percent * |A | B| for their sets of
    five-word shingles; a component takes its smallest id, whose document is kept.
    """
    out = groups(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def first_of_groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row with the smallest id stays, once.

    Rows without an id come after all others. Rows without words stay.
    """
    key, own = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), unused(docs, "row")
    all_ = cut(groups(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), percent).where("component is not null"))
    first = all_.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = small(hot_join(all_, first, "component", "row", all_.count()).where(F.col("row") != F.col("first.row")).select(F.col("row").alias(own)).distinct())
    left = docs.join(gone, key == F.col(own), "left_anti")
    repeated = small(all_.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row").alias(own)))
    if repeated.isEmpty():
        return left
    once = left.join(repeated, key == F.col(own)).dropDuplicates([own]).drop(own)
    return left.join(repeated, key == F.col(own), "left_anti").union(once)


def groups(texts: DataFrame, percent: int) -> DataFrame:
    """``row, doc_id, n_shingles, component, component_id`` for every ``doc_id, text``: its component and the smallest id there.

    ``row`` stands for id and text. A text without words has no component and its own id.
    """
    prepare(texts.sparkSession)
    need = match_threshold(percent / 100)
    all_ = cut(features(texts))
    same = ["p1", "p2", "n_shingles"]
    by = all_.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("signature").alias("signature"), F.min(F.struct("k1", "k2")).alias("body"))
    classes = cut(by.withColumn("member", F.monotonically_increasing_id()))
    rows, total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

    def bodies(wanted: DataFrame) -> DataFrame:
        chosen = classes.select("member", "body.k1", "body.k2").join(wanted, "member")
        return sieve(texts.select("text", *prints()), chosen, "k1").dropDuplicates(["k1", "k2"]).join(chosen, ["k1", "k2"]).select("member", "text")

    lists = cut(prefixes(classes, need, total))
    found = links(lists, classes.select("member", F.col("n_shingles").alias("size")), bodies, percent, classes.select("member", F.col("signature").alias("x")), need)
    joined = classes.drop("signature", "body").join(connected_components(found).withColumnRenamed("node", "member"), "member", "left").withColumn("component", F.coalesce("component", "member"))
    named = cut(hot_join(joined.withColumnRenamed("n", "copies"), joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "component", "member", total).select(*same, "component", "component_id", F.col("copies").alias("n")))
    full = hot_join(all_.where("n_shingles > 0").drop("signature"), named, "p1", "doc_id", rows, ["p2", "n_shingles"]).select("row", "doc_id", "n_shingles", "component", "component_id")
    empty = all_.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.lit(None).cast("long"), F.col("doc_id"))
    return full.union(empty)


def op8_minhash_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents at 85 percent."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


#: The same rows by comparing every two documents that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
    ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * c >= 85 * (i.n + j.n - c)
), both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, t.b FROM reach r JOIN both_ t ON r.b = t.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
