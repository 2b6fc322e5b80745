"""Sharding by histogram sort.

Documents are ordered by (hash of the text, doc_id, a stored number), so equal texts are
neighbours and stay together where balance allows. The boundaries between
shards are found by counting exact bytes: each round counts the bytes under every child of
the key prefixes that still hold a boundary, picks a child boundary where one
is within the tolerance of its target, and goes one digit deeper where none is. A
text that fills whole shards is cut inside by doc_id in the same way, and rows that share both by their
number, which is drawn once and kept in the checkpoint folder with the row. Rows then
move once, to their part of a shard.

Law: ``bytes``. Shards differ by less than twice the tolerance, or by
single rows larger than that.

A shard has up to ``MAX_PARTS`` parts of about ``PART_ROWS`` rows; with more rows than both allow, parts
grow, and the sort inside a part spills.

Edge cases. A null text has no bytes, size 1 and checksum 0, as an empty one. Repeated rows and rows
without an id are rows like all others; a null id counts as 0. Fewer rows than
shards leave shards empty; an empty table gives an empty result. Very long texts are one row, whatever their
bytes. Extra columns go along; columns of the names that are
added (``size, text_crc32, shard, slot``) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

SHARDS = 16
#: Tolerance as a share of a part; rows of a part of a shard, and the most parts of one.
TOLERANCE, PART_ROWS, MAX_PARTS = 0.002, 4096, 256
#: Digits of the key, first to last: column, shift, bits.
KEY = ["_key_hash", "_key_id", "_key_tie"]
DIGITS = [(c, shift, bits) for c in KEY for shift, bits in ((52, 12), *((s, 6) for s in range(46, 3, -6)), (0, 4))]
#: Digits of a column, and what is beyond all keys.
EACH, BEYOND = len(DIGITS) // 3, (2**63 - 1,) * 3


def digit(level: int) -> Column:
    """A digit of the key as an unsigned number; signed columns are shifted so that order stays."""
    col, shift, bits = DIGITS[level]
    n = F.shiftright(F.col(col), shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("long")
    return F.pmod(n + (1 << bits - 1), F.lit(1 << bits)).cast("long") if level % EACH == 0 else n


def prefix(levels: int) -> Column:
    return F.concat_ws(".", *(digit(i) for i in range(levels))) if levels else F.lit("")


def _signed(bits: list[int], first: int) -> int:
    """The smallest signed value with these leading digits, the digit numbers counting from ``first``."""
    value = 0
    for i, x in enumerate(bits):
        _, shift, width = DIGITS[first + i]
        value |= ((x + (1 << width - 1)) % (1 << width) if i == 0 else x) << shift
    return value - (1 << 64) if value >> 63 else value


def boundary(path: list[int]) -> tuple[int, int, int]:
    """The smallest key under a prefix."""
    return tuple(_signed(path[k : k + EACH] or [0], k) for k in range(0, 3 * EACH, EACH))


def splitters(keys: DataFrame, parts: int) -> list[tuple[int, int, int]]:
    """Keys that cut the rows into ``parts`` runs of nearly equal bytes, by rounds of exact counts."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [boundary([])] * (parts - 1)
    near = max(1.0, TOLERANCE * total / parts)
    found: dict[int, tuple[int, int, int]] = {}
    inside: dict[tuple, list[int]] = {(): list(range(1, parts))}
    below: dict[tuple, int] = {(): 0}
    for level in range(len(DIGITS)):
        if not inside:
            break
        rows = keys
        if level:  # as many prefixes as boundaries, at most
            live = keys.sparkSession.createDataFrame([(".".join(map(str, p)),) for p in inside], "live string")
            rows = keys.join(F.broadcast(live), prefix(level) == F.col("live"))
        counts: dict[tuple, list[tuple[int, int]]] = {}
        for p, x, n in rows.groupBy(prefix(level).alias("p"), digit(level).alias("x")).agg(F.sum("size")).collect():
            counts.setdefault(tuple(map(int, p.split("."))) if p else (), []).append((x, n))
        deeper: dict[tuple, list[int]] = {}
        for p, targets in inside.items():
            edges, at = [], below[p]
            for x, n in sorted(counts.get(p, [])):
                edges.append((x, at, at + n))
                at += n
            k = 0
            for t in targets:
                want = t * total / parts
                while k + 1 < len(edges) and edges[k][2] <= want:
                    k += 1
                x, lo, hi = edges[k]
                last = level + 1 == len(DIGITS)
                if hi - want <= near or last and hi - want < want - lo:
                    after = list(p)
                    found[t] = boundary([*after, x + 1]) if x + 1 < 1 << DIGITS[level][2] else _after([*after, x])
                elif want - lo <= near or last:
                    found[t] = boundary([*p, x])
                else:
                    deeper.setdefault((*p, x), []).append(t)
                    below[*p, x] = lo
        inside = deeper
    return [found[t] for t in range(1, parts)]


def _after(path: list[int]) -> tuple[int, int, int]:
    """The smallest key beyond a prefix whose last digit is the highest."""
    while path and path[-1] + 1 == 1 << DIGITS[len(path) - 1][2]:
        path = path[:-1]
    return boundary([*path[:-1], path[-1] + 1]) if path else BEYOND


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``size, text_crc32`` and the key."""
    text = F.col(text_col).cast("string")
    return docs.withColumns(
        {
            "_key_hash": F.xxhash64(F.coalesce(text, F.lit(""))),
            "_key_id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)),
            "_key_tie": F.xxhash64(F.monotonically_increasing_id()),
            "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
            "text_crc32": F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long"),
        }
    )


def placed(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Keyed rows, computed already, with ``shard`` and ``slot`` instead of the key."""
    keys = rows.select(*KEY, "size")
    per_shard = max(1, min(MAX_PARTS, -(-keys.count() // (shards * PART_ROWS))))
    cuts = splitters(keys, shards * per_shard)
    own_key = F.struct(*KEY)
    literal = lambda key: F.struct(*(F.lit(v).alias(c) for c, v in zip(KEY, key, strict=True)))
    shard = sum(((own_key >= literal(cuts[i * per_shard - 1])).cast("int") for i in range(1, shards)), F.lit(0))
    inner = [cuts[i * per_shard : (i + 1) * per_shard - 1] for i in range(shards)]
    if per_shard > 1:
        lists = F.array(*(F.array(*map(literal, own)) for own in inner))
        part = F.size(F.filter(F.element_at(lists, F.col("shard") + 1), lambda s: s <= own_key))
    else:
        part = F.lit(0)
    rows = rows.withColumn("shard", shard).withColumn("_part", part)
    held = cut(rows.groupBy("shard", "_part").agg(F.count("*").alias("n")))
    before = held.select("shard", "_part", (F.sum("n").over(W.partitionBy("shard").orderBy("_part")) - F.col("n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("shard", "_part").orderBy(*KEY)) - 1
    return rows.withColumn("_own", own).join(before, ["shard", "_part"]).withColumn("slot", (F.col("_own") + F.col("_before")).cast("long")).drop(*KEY, "_part", "_own", "_before")


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``size, text_crc32, shard, slot``; slots follow the key order, gapless from 0."""
    return placed(cut(keyed(docs, id_col, text_col)), shards)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the documents as Parquet, a folder for each shard."""
    assign(docs, shards).write.partitionBy("shard").parquet(path)


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    rows = cut(keyed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return placed(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
