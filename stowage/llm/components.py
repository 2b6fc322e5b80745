"""Connected components of an edge table, by alternating large and small stars.

Tasks contract their edges to forests first. As soon as what is left fits into one
task (``CHUNK`` edges), that task finishes. Until then every round is a few aggregations and
joins on node ids. A node with very many neighbours is an aggregation key (combined
before the shuffle) and a join key whose one row on the right is broadcast (``key_join``); no
task gathers its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, key_join

#: Edges that a task contracts at once, 16 bytes each.
CHUNK = 200_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node that it reaches; numpy min-label hooking."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    away = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[away], nodes[root[away]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0

    def star() -> pa.RecordBatch:
        u = np.concatenate([b.column(0).to_numpy() for b in held])
        v = np.concatenate([b.column(1).to_numpy() for b in held])
        x, y = forest(u, v)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield star()
            held, rows = [], 0
    if held:
        yield star()


def connected_components(edges: DataFrame) -> DataFrame:
    """The component of every node that has an edge.

    ``edges`` has two bigint columns, in any direction, with repeats and loops
    allowed; rows with a null are ignored. Returns ``node`` and ``component``, the smallest
    node that it reaches. An empty table gives an empty table.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    now = cut(pairs.mapInArrow(_contract, "u long, v long").distinct())
    state = _state(now)
    while state[0] > CHUNK:
        # each join is computed before the next: as one plan a round takes much of the driver's memory
        both = now.union(now.select("v", "u"))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = cut(key_join(both, least, "u", 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = key_join(large, least, "u", 2 * state[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = cut(small.union(least.select("u", "m")).distinct())
        after = _state(nxt)
        now, done, state = nxt, after == state, after
        if done:
            break
    if state[0] <= CHUNK:
        now = now.coalesce(1).mapInArrow(_contract, "u long, v long")
    least = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(least)


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksums of the edges: equal states mean a fixed point."""
    row = edges.agg(
        F.count("*"),
        F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")),
        F.sum(F.hash("v", "u").cast("long")),
    ).first()
    return tuple(row)
