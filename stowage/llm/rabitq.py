"""Embedding near-duplicates by randomised-rotation binary codes.

A vector is scaled to length one, rotated at random and kept as the signs of
its coordinates, with the inner product of signs and rotated vector as a
correction factor. Signs and factor give an unbiased estimate of the inner product with
any other vector, whose rotated coordinates are kept in four bits each (rounded at random), by counting bits. The
estimate has a bound that it exceeds with a known, very small probability:
only pairs whose upper bound reaches the threshold are computed in full.

Codes, factors and rounded coordinates of all vectors are worked out once and stored. Pairs are looked for where
codes agree: bands of sign bits, as many as the miss rate at the threshold asks for, are join keys.
The width of a band follows the number of vectors, so the vectors of a band value stay few. Only
codes are sent to the band values; the vectors themselves follow where a bound left a pair over.

Skew. Equal vectors are one class from the start. A band value that very many
classes share is dealt to pairs of bounded blocks. A block pair gives the
number of links of each of its classes and a spanning forest of them, so what
leaves a task is linear in what enters it; a pair counts in the first band in which it agrees.

Edge cases. Vectors that are null, empty, zero, or hold null or non-finite
components link with nothing. Vectors of different length do not link. A row without an id counts as another
vector; a component of such rows alone has no id. Rows that share an id go each by their own vector, repeated
rows are copies of each other. Very long vectors are taken whole. An empty table gives an empty result. Extra
columns are ignored, also those with names of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_group, cut, hot_join, pair_blocks, prepare, table
from .components import connected_components, forest

#: Share of links at the threshold that may meet in no band; standard deviations of the bound; vectors of a band value and of a block.
MISS, DEVIATIONS, PER_VALUE, BLOCK = 1e-4, 4.5, 2048, 4096
#: Rotations that an estimate takes the mean of, and bits of a rounded coordinate.
ESTIMATES, DEPTH = 2, 4


def padded(dims: int) -> int:
    """Coordinates of a rotated vector: a multiple of 64."""
    return -(-dims // 64) * 64


@lru_cache(maxsize=16)
def rotation(dims: int, number: int) -> np.ndarray:
    """The first ``dims`` columns of a random orthonormal matrix."""
    size = padded(dims)
    q, r = np.linalg.qr(np.random.default_rng([dims, number]).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:, :dims]


def bands(classes: int, threshold: float) -> tuple[int, int]:
    """Bits of a band and number of bands."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(24, max(4, round(math.log2(max(1, classes / PER_VALUE)))))
    return bits, math.ceil(math.log(MISS) / math.log1p(-(agree**bits)))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Stored codes of vectors of one length, as rows of bytes.

    Sign bits of all rotations; for those that estimate, the bit planes of the rounded coordinates;
    and as floats the correction factor, the least coordinate and the step of the rounding.
    """

    def __init__(self, raw: np.ndarray, dims: int) -> None:
        words, n = padded(dims) // 64, len(raw)
        tail = 8 * ESTIMATES * DEPTH * words + 12 * ESTIMATES
        head = raw.shape[1] - tail
        self.signs = np.ascontiguousarray(raw[:, :head]).view(np.uint64).reshape(n, -1, words)
        self.planes = np.ascontiguousarray(raw[:, head : head + tail - 12 * ESTIMATES]).view(np.uint64).reshape(n, ESTIMATES, DEPTH, words)
        self.factor, self.least, self.step = np.moveaxis(np.ascontiguousarray(raw[:, -12 * ESTIMATES :]).view(np.float32).reshape(n, ESTIMATES, 3).astype(np.float64), 2, 0)
        self.dims, self.size = dims, padded(dims)

    @staticmethod
    def encode(vectors: np.ndarray, rotations: int, first: int = 0) -> np.ndarray:
        """The codes by so many rotations, numbered from ``first``."""
        x = unit(vectors)
        n, dims = x.shape
        signs, planes, floats = [], [], []
        for r in range(rotations):
            y = x @ rotation(dims, first + r).T
            signs.append(np.packbits(y > 0, axis=1, bitorder="little"))
            if r < ESTIMATES:
                least = y.min(axis=1)
                step = np.maximum((y.max(axis=1) - least) / (2**DEPTH - 1), 1e-12)
                # the same random offset for all vectors: a rounded coordinate is right on average
                u = np.random.default_rng([dims, first + r, 1]).random(y.shape[1])
                k = np.clip(np.floor((y - least[:, None]) / step[:, None] + u), 0, 2**DEPTH - 1).astype(np.uint8)
                planes += [np.packbits((k >> d) & 1, axis=1, bitorder="little") for d in range(DEPTH)]
                floats += [np.abs(y).sum(axis=1) / math.sqrt(y.shape[1]), least, step]
        return np.concatenate([*signs, *planes, np.stack(floats, axis=1).astype(np.float32).view(np.uint8).reshape(n, -1)], axis=1)

    def values(self, bits: int, count: int) -> np.ndarray:
        """The value of every band of every row."""
        each = self.size // bits
        flat = np.unpackbits(self.signs.view(np.uint8).reshape(len(self.signs), -1, self.size // 8), axis=2, bitorder="little")[:, :, : each * bits]
        return (flat.reshape(len(flat), -1, each, bits) @ (1 << np.arange(bits)).astype(np.int64)).reshape(len(flat), -1)[:, :count]

    def estimate(self, rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products of coded ``rows`` with the rounded ``others``, and by row what they are hardly ever off by."""
        total, spread = np.zeros((len(rows), len(others))), np.zeros(len(rows))
        for r in range(ESTIMATES):
            signs = self.signs[rows, r]
            ones = np.bitwise_count(signs).sum(axis=1, dtype=np.int64)
            sums = np.zeros((len(rows), len(others)), np.int32)
            level = np.zeros(len(others), np.int64)
            for d in range(DEPTH):
                plane = self.planes[others, r, d]
                level += np.bitwise_count(plane).sum(axis=1, dtype=np.int64) << d
                for w in range(plane.shape[1]):
                    sums += np.bitwise_count(signs[:, None, w] & plane[None, :, w]).astype(np.int32) << d
            least, step, factor = self.least[others, r], self.step[others, r], self.factor[rows, r]
            # signs are 2 b - 1 for bits b
            inner = 2 * (ones[:, None] * least + sums * step) - (self.size * least + level * step)
            total += inner / (math.sqrt(self.size) * factor[:, None])
            spread += (1 - factor**2).clip(0) / factor**2 / max(1, self.size - 1) + self.step[others, r].max(initial=0) ** 2 / 6 / factor**2
        return total / ESTIMATES, DEVIATIONS * np.sqrt(spread) / ESTIMATES

    def pairs(self, left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows whose upper bound reaches the threshold, each once where both sides are the same."""
        for lo in range(0, len(left), 256):
            part = left[lo : lo + 256]
            about, margin = self.estimate(part, right)
            i, j = np.nonzero(about + margin[:, None] >= threshold)
            i, j = part[i], right[j]
            if same:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 65_536):
                yield i[at : at + 65_536], j[at : at + 65_536]


def _list(band: int | np.ndarray, dims: int, values: np.ndarray) -> np.ndarray:
    """One number for a band, a length of vectors and a value."""
    return (np.int64(band) << 48) | np.int64(dims << 24) | values


def _encode(bits: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, column = batch.column(0).to_numpy(), batch.column(1)
            lengths = column.value_lengths().to_numpy()
            flat, at = column.flatten().to_numpy(), np.cumsum(lengths) - lengths
            for dims in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dims)
                each = max(1, (1 << 20) // dims)  # vectors at a time: a million coordinates
                for lo in range(0, len(own), each):
                    some = own[lo : lo + each]
                    raw = Codes.encode(flat[at[some][:, None] + np.arange(dims)], max(ESTIMATES, -(-count // (padded(dims) // bits))))
                    values = Codes(raw, dims).values(bits, count)
                    lists = np.stack([_list(b, dims, values[:, b]) for b in range(count)], axis=1)
                    ends = pa.array(np.arange(len(some) + 1) * count, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(members[some]), pa.ListArray.from_arrays(ends, pa.array(lists.ravel())), pa.array([r.tobytes() for r in raw], pa.binary())], names=["member", "lists", "code"])

    return run


def _codes(key: tuple, rows: pa.Table) -> tuple[Codes, np.ndarray, np.ndarray]:
    """The codes of a cell and the rows of its two sides."""
    raw = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in rows["code"]])
    mine = rows["mine"].to_numpy()
    return Codes(raw, int(key[0] >> 24) & 0xFFFFFF), np.flatnonzero(mine == key[1]), np.flatnonzero(mine == key[2])


def _promising(threshold: float):
    """The members of a cell that have a pair whose bound reaches the threshold."""

    def run(key: tuple, rows: pa.Table) -> pa.RecordBatch | None:
        codes, left, right = _codes(key, rows)
        hit = np.zeros(rows.num_rows, bool)
        for i, j in codes.pairs(left, right, key[1] == key[2], threshold):
            hit[i] = hit[j] = True
        at = np.flatnonzero(hit)
        return pa.RecordBatch.from_arrays([*(pa.array(np.full(len(at), k)) for k in key), *(pa.array(rows[c].to_numpy()[at]) for c in ("member", "mine"))], names=["list", "bi", "bj", "member", "mine"])

    return run


def _links(bits: int, threshold: float):
    """Links and a forest of the pairs of a cell, computed in full where their bounds don't decide."""

    def run(key: tuple, rows: pa.Table) -> pa.RecordBatch | None:
        codes, left, right = _codes(key, rows)
        members, copies = rows["member"].to_numpy(), rows["copies"].to_numpy()
        x = unit(rows["v"].combine_chunks().flatten().to_numpy().reshape(len(members), -1))
        band = int(key[0] >> 48)
        values = codes.values(bits, band)
        links, u, v = np.zeros(len(members), np.int64), [], []
        for i, j in codes.pairs(left, right, key[1] == key[2], threshold):
            near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            i, j = i[near], j[near]
            if band:  # counted where the pair first agrees
                first = ~(values[i] == values[j]).any(axis=1)
                i, j = i[first], j[first]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            if len(i):
                p, q = forest(members[i], members[j])
                u.append(p)
                v.append(q)
        if not u:
            return None
        p, q = forest(np.concatenate(u), np.concatenate(v))
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([members[some], p])), pa.array(np.concatenate([links[some], np.zeros(len(p), np.int64)])), pa.array(np.concatenate([members[some], q]))],
            names=["u", "links", "v"],
        )

    return run


def near_vectors(rows: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector; vectors link at a cosine of at least ``threshold``."""
    prepare(rows.sparkSession)
    fine = F.expr("size(v) > 0 and forall(v, x -> x is not null and x = x and abs(x) < double('Infinity') and not isnan(x)) and exists(v, x -> x <> 0)")
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    vectors = named.where("fine").select("vec_id", "v", F.xxhash64("v").alias("h"))
    classes = cut(vectors.groupBy("h", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("member", F.monotonically_increasing_id()))
    size, count_all = classes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    bits, count = bands(size, threshold)
    codes = cut(classes.select("member", "v").mapInArrow(_encode(bits, count), "member long, lists array<long>, code binary"))
    posts = codes.select(F.explode("lists").alias("list"), "member", "code")
    # only values with more than a block need a number of blocks
    large = codes.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = pair_blocks(posts.join(large, "list", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), "member", "blocks")
    keys = ["list", "bi", "bj"]
    cells = cut(by_group(dealt, keys, _promising(threshold), "list long, bi int, bj int, member long, mine int"))
    full = cells.join(codes.select("member", "code"), "member").join(classes.select("member", "copies", "v"), "member")
    found = cut(by_group(full, keys, _links(bits, threshold), "u long, links long, v long"))
    linked = found.where("links > 0").groupBy(F.col("u").alias("member")).agg(F.sum("links").alias("links"))
    joined = classes.drop("v").join(connected_components(found.where("u <> v").select("u", "v")).withColumnRenamed("node", "member"), "member", "left").withColumn("component", F.coalesce("component", "member"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    own = hot_join(joined.select("member", "component"), least, "component", "member", size)
    known = cut(classes.join(own, "member").join(linked, "member", "left").select("h", "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n")))
    out = hot_join(vectors, known, "h", "vec_id", count_all, ["v"]).select("vec_id", "n_links", "component_id")
    none = named.where("not fine").select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    return out.union(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors at a cosine of 0.9."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
