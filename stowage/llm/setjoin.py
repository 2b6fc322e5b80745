"""Exact links among members that share lists: a similarity join over shingle sets.

Two members are compared if they share a list (an inverted list of a signature
coordinate, or a band). Their numbers of common signature coordinates are
counted first, where signatures are given; the exact Jaccard similarity of the full sets decides.

First every member of a list is compared with the list's pivot, its smallest member:
a number of pairs that is linear in the lists, each compared once however many lists it shares.
In a group of near copies this links nearly everything. What is left are the lists whose members are still in
several components. There, the members of the largest component are not compared with each other: they are
dealt to bounded blocks that only meet the blocks of the others. A cell of two blocks first sees signatures,
and only its members that have a candidate send their texts. It gives a spanning forest of its links,
so what leaves a task is linear in what enters it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, by_group, cut, key_join, pair_blocks
from .components import connected_components
from .words import distinct, shingle_sets

WIDTH = 5
#: Members of a block; bytes of shingle hashes of a block.
BLOCK, CELL_BYTES = 512, 8 << 20


def stars(pairs: DataFrame, payload: DataFrame, fn: Callable, kind: str) -> DataFrame:
    """Runs ``fn`` over pairs (pivot, member) with their payloads: the pivot's comes first, once for a bucket of its members.

    ``payload`` has ``member`` and one column ``x``; ``kind`` is its type.
    """
    dealt = pairs.select("pivot", F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int").alias("salt"), "member")
    members = dealt.join(payload, "member").select("pivot", "salt", "member", "x")
    heads = dealt.select("pivot", "salt").distinct().join(payload.withColumnRenamed("member", "pivot"), "pivot").select("pivot", "salt", F.lit(-1).cast("long").alias("member"), F.col("x").cast(kind).alias("x"))
    return heads.union(members).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "member").select("pivot", "member", "x").mapInArrow(fn, "u long, v long")


def matching(a: np.ndarray, b: np.ndarray, need: int) -> np.ndarray:
    """Which rows have ``need`` equal coordinates. Rows that can't reach it after half of them are skipped."""
    half = a.shape[-1] // 2
    count = np.count_nonzero(a[..., :half] == b[..., :half], axis=-1)
    out = count + (b.shape[-1] - half) >= need
    at = np.flatnonzero(out)
    rest = a[at, half:] if a.ndim > 1 else a[half:]
    out[at] = count[at] + np.count_nonzero(rest == b[at, half:], axis=-1) >= need
    return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _counted(need: int):
    """Pairs with enough common coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            if not batch.num_rows:
                continue
            pivot, member, sig = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            if head is not None:  # of the batch before
                pivot, member, sig = np.concatenate([head[:1], pivot]), np.concatenate([[-1], member]), np.concatenate([head[1], sig])
            at = np.maximum.accumulate(np.where(member < 0, np.arange(len(member)), 0))
            hit = np.flatnonzero((member >= 0) & matching(sig[at], sig, need))
            head = (pivot[at[-1]], sig[at[-1] : at[-1] + 1])
            yield pa.RecordBatch.from_arrays([pa.array(pivot[hit]), pa.array(member[hit])], names=["u", "v"])

    return run


def _verified(percent: int):
    """Pairs whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.empty(0, np.uint64)
        for batch in batches:
            pivot, member = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            hit = np.zeros(len(member), bool)
            for i, own in shingle_sets(batch.column(2), WIDTH):
                if member[i] < 0:
                    head = own
                elif 100 * min(len(own), len(head)) >= percent * max(len(own), len(head)):
                    both = len(own) + len(head) - len(distinct(np.concatenate([own, head])))
                    hit[i] = 100 * both >= percent * (len(own) + len(head) - both)
            yield pa.RecordBatch.from_arrays([pa.array(pivot[hit]), pa.array(member[hit])], names=["u", "v"])

    return run


def walk(ids: np.ndarray, sub: np.ndarray, near) -> pa.RecordBatch | None:
    """A spanning forest of the links between rows of different ``sub``, of which rows are linked already.

    ``near(row, rest)`` tells which of the rows ``rest`` link with ``row``; rows that are reached are not compared again.
    """
    left, u, v = np.arange(len(ids)), [], []
    todo: list[int] = []
    while len(left):
        if not todo:
            todo.extend(left[sub[left] == sub[left[0]]].tolist())
            left = left[sub[left] != sub[left[0]]]
            continue
        at = todo.pop()
        found = left[near(at, left)]
        if len(found):
            u.append(np.full(len(found), ids[at]))
            v.append(ids[found])
            reached = np.isin(sub[left], sub[found])
            todo.extend(left[reached].tolist())
            left = left[~reached]
    if not u:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])


def _promising(need: int):
    """The members of a cell that have a candidate in another component."""

    def run(key: tuple, rows: pa.Table) -> pa.RecordBatch | None:
        sub, sig = rows["sub"].to_numpy(), _matrix(rows["x"])
        hit = np.zeros(len(sub), bool)
        for at in range(len(sub) - 1):
            rest = at + 1 + np.flatnonzero(sub[at + 1 :] != sub[at])
            found = rest[matching(sig[at], sig[rest], need)]
            hit[found] = True
            hit[at] |= len(found) > 0
        at = np.flatnonzero(hit)
        cols = [pa.array(np.full(len(at), k)) for k in key]
        return pa.RecordBatch.from_arrays([*cols, pa.array(rows["member"].to_numpy()[at]), pa.array(sub[at])], names=["list", "bi", "bj", "member", "sub"])

    return run


def _exact(percent: int, need: int | None):
    """A forest of the pairs of a cell whose full sets reach the similarity."""

    def run(key: tuple, rows: pa.Table) -> pa.RecordBatch | None:
        ids, sub = rows["member"].to_numpy(), rows["sub"].to_numpy()
        sets = [s for _, s in shingle_sets(rows["text"], WIDTH)]
        sizes = np.array([len(s) for s in sets])
        sig = _matrix(rows["x"]) if need else None
        # dense numbers for the shingles that more than one row has; the others only count in sizes
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        new = np.ones(len(flat), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        number = np.empty(len(flat), np.int64)
        number[order] = np.cumsum(new) - 1
        shared = np.bincount(number)[number] > 1
        number, owner = number[shared], owner[shared]
        ends = np.searchsorted(owner, np.arange(len(ids) + 1))
        mark = np.zeros(int(new.sum()), np.uint8)

        def near(at: int, rest: np.ndarray) -> np.ndarray:
            out = np.zeros(len(rest), bool)
            a, lengths = sizes[at], sizes[rest]
            fits = np.flatnonzero((100 * np.minimum(a, lengths) >= percent * np.maximum(a, lengths)) & (ends[rest + 1] > ends[rest]))
            if need and len(fits):
                fits = fits[matching(sig[at], sig[rest[fits]], need)]
            if not len(fits):
                return out
            own = rest[fits]
            mark[number[ends[at] : ends[at + 1]]] = 1
            amount = ends[own + 1] - ends[own]
            first = np.cumsum(amount) - amount
            inside = np.repeat(ends[own] - first, amount) + np.arange(amount.sum())
            both = np.add.reduceat(mark[number[inside]].astype(np.int64), first)
            mark[number[ends[at] : ends[at + 1]]] = 0
            out[fits] = 100 * both >= percent * (a + sizes[own] - both)
            return out

        return walk(ids, sub, near)

    return run


def links(lists: DataFrame, sizes: DataFrame, bodies: Callable[[DataFrame], DataFrame], percent: int, signatures: DataFrame | None = None, need: int | None = None) -> DataFrame:
    """A forest ``u, v`` of the pairs that share a list and whose sets have a Jaccard similarity of percent / 100.

    ``lists`` has distinct ``list, member`` and is computed already, ``sizes`` has ``member, size`` (shingles),
    ``bodies`` gives ``member, text`` for a table of members, and ``signatures`` has ``member, x``: pairs with
    fewer than ``need`` equal coordinates don't link. Member numbers are 0 or more.
    """
    pivots = cut(lists.groupBy("list").agg(F.min("member").alias("pivot"), F.count("*").alias("n")).where("n > 1"))
    total = pivots.agg(F.sum("n")).first()[0] or 0
    met = cut(key_join(lists, pivots, "list", total).where("member <> pivot"))
    pairs = met.select("pivot", "member").distinct()
    if need:
        pairs = cut(stars(pairs, signatures, _counted(need), "array<int>")).toDF("pivot", "member")
    else:
        pairs = cut(pairs)
    own = bodies(pairs.select("member").union(pairs.select("pivot")).distinct()).withColumnRenamed("text", "x")
    first = cut(stars(pairs, own, _verified(percent), "string"))
    # the pivot has met its whole list; lists of one component are done
    known = sizes.join(connected_components(first).withColumnRenamed("node", "member"), "member", "left").select("member", "size", F.coalesce("component", "member").alias("sub"))
    rest = cut(met.select("list", "member").join(known, "member"))
    by = rest.groupBy("list", "sub").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    by = by.groupBy("list").agg(F.sum("c").alias("n"), F.sum("s").alias("all"), F.max(F.struct("c", "s", "sub")).alias("major")).where("major.c < n")
    blocks = lambda c, s: F.ceil(F.greatest(c / BLOCK, s * 8 / CELL_BYTES)).cast("int")
    open_ = cut(by.select("list", "n", F.col("major.sub").alias("major"), blocks(F.col("n") - F.col("major.c"), F.col("all") - F.col("major.s")).alias("others"), blocks(F.col("major.c"), F.col("major.s")).alias("blocks")))
    dealt = key_join(rest, open_, "list", total).withColumn("blocks", F.col("blocks") + F.col("others"))
    cells = pair_blocks(dealt.withColumn("minor", F.col("sub") != F.col("major")), "member", "blocks", "minor", "others").select("list", "bi", "bj", "member", "sub")
    keys = ["list", "bi", "bj"]
    if need:
        cells = cut(by_group(cells.join(signatures, "member"), keys, _promising(need), "list long, bi int, bj int, member long, sub long"))
    else:
        cells = cut(cells)
    full = cells.join(bodies(cells.select("member").distinct()), "member")
    if need:
        full = full.join(signatures, "member")
    # computed here: a step in Python that follows in the same tasks would need workers of its own beside these
    return first.union(cut(by_group(full, keys, _exact(percent, need), "u long, v long")))
