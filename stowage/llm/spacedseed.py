"""Benchmark decontamination by spaced-seed hashing.

A mask such as ``1101101011`` hashes the words under its ones and ignores those
under its zeros, so a test passage is still found when a word at an ignored
position was changed. Seeds of the benchmark are joined with seeds of the
documents on their hash; each hit fixes an alignment (item, offset), on which
the item is laid over the whole document and the best substitution-tolerant
overlap is measured. Items shorter than a seed are found by the hash of all their words.

Document seeds are first tested against a bitmap of the benchmark's seeds: it
has a fixed size whatever the benchmark has and
only lets through more or fewer rows into the join. Texts are only sent on where a
seed was hit (``sieve``): each meets its alignments as a stream, one row for an item.

Skew. Hits of a very common seed, and documents with a very common item, are dealt to
buckets (``hot_join``). Repeated rows are measured once.

Edge cases. Null or empty texts match nothing; rows without an id are reported without one. An overlap needs
``MIN_WORDS`` matching words, or ``IDENTITY`` of the item's if these are fewer; an item under
``SEED`` words has to be there whole, however short it is. Repeated items are each reported, also those that
share an id. A document that has an item several times is reported once, with its
best overlap (then the first); texts that share a doc_id are reported each, repeated rows once. An empty table on
either side gives an empty result. Very long texts are hashed in pieces. Extra columns are
ignored, also those with names of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_join, prepare, sieve, small, table, unused
from .words import U, powers, rounds, strings, word_hashes

MASKS = ("1111111", "1101101011", "1011011011", "11100110101")
#: Words of the shortest mask.
SEED = 7
#: Matching words that an overlap needs, the share of its words that match, and the bits of the bitmap.
MIN_WORDS, IDENTITY, BITMAP_BITS = 12, 0.8, 23


def needed(words: int) -> int:
    """Matching words that an overlap with an item of so many words needs."""
    return words if words < SEED else min(MIN_WORDS, -(-words * Fraction(str(IDENTITY)).numerator // Fraction(str(IDENTITY)).denominator))


def seeds(words: np.ndarray, counts: np.ndarray, bitmap: np.ndarray | None, short: tuple[int, ...], whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and word position of every seed that lies within a row (and is in the bitmap).

    ``short`` has the lengths of items below ``SEED`` words: runs of so many words are hashed too,
    with ``whole`` only those that are a row.
    """
    ends = np.cumsum(counts)
    factors = powers(0xC2B2AE3D27D4EB4F, 64)
    scaled: dict[int, np.ndarray] = {}
    out = []
    for m, mask in enumerate((*MASKS, *("1" * k for k in short))):
        n = len(words) - len(mask) + 1
        if n <= 0:
            continue
        total = np.full(n, factors[50 + m] if m < len(MASKS) else factors[56 + len(mask)])
        for k, bit in enumerate(mask):
            if bit == "1":
                if k not in scaled:
                    scaled[k] = words * factors[k + 1]
                total += scaled[k][k : k + n]
        at = np.arange(n) if bitmap is None else np.flatnonzero(bitmap[total >> U(64 - BITMAP_BITS)])
        row = np.searchsorted(ends, at, "right")
        inside = at + len(mask) <= ends[row]
        if whole and m >= len(MASKS):
            inside &= counts[row] == len(mask)
        at, row = at[inside], row[inside]
        out.append((total[at], row, at - (ends[row] - counts[row])))
    if not out:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _seeds(bitmap, short: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).view(bool)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = strings(batch.column(1))
            for lo, hi in rounds(offsets):
                part = offsets[lo : hi + 1]
                h, row, at = seeds(*word_hashes(data[part[0] : part[-1]], part - part[0]), table_, short)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[lo + row]), pa.array(at)], names=["h", "row", "at"])

    return run


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, column = batch.column(0).to_numpy(), batch.column(1)
        counts = column.value_lengths().to_numpy().astype(np.int64)
        h, row, at = seeds(column.flatten().to_numpy().view(np.uint64), counts, None, tuple(range(1, SEED)), whole=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(items[row]), pa.array(at)], names=["h", "item", "item_at"])


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << BITMAP_BITS, bool)
    for batch in batches:
        bits[batch.column(0).to_numpy().view(np.uint64) >> U(64 - BITMAP_BITS)] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])


def overlap(doc: np.ndarray, item: np.ndarray, offset: int) -> tuple[int, int, int]:
    """The best overlap of an item laid over a document from word ``offset``: matches, first word in the document, words.

    Of all runs of words of which at least ``IDENTITY`` match, the one with most matches, from its first match to its last.
    """
    a, b = max(0, -offset), min(len(item), len(doc) - offset)
    if b <= a:
        return 0, 0, 0
    same = doc[offset + a : offset + b] == item[a:b]
    share = Fraction(str(IDENTITY))
    # in whole numbers, a run's total is 0 or more where its share is reached
    total = np.concatenate([[0], np.cumsum(np.where(same, share.denominator - share.numerator, -share.numerator))])
    count = np.concatenate([[0], np.cumsum(same)])
    # for every end, the first start from which the total is 0 or more
    first = np.searchsorted(-np.minimum.accumulate(total), -total)
    stop = int(np.argmax(count - count[first]))
    start = int(first[stop])
    n = int(count[stop] - count[start])
    if not n:
        return 0, 0, 0
    start += int(np.argmax(same[start:stop]))
    return n, offset + a + start, stop - start


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (row, item): first the text of a row, then for each item its words and offsets."""
    key, held = None, []
    for batch in batches:
        out: list[tuple] = []
        rows, kinds, doc_ids, item_ids = (batch.column(c).to_pylist() for c in ("row", "item", "doc_id", "item_id"))
        offsets, items = batch.column("offsets"), batch.column("words")
        data, ends = strings(batch.column("text"))
        for i, row in enumerate(rows):
            if row != key:
                key, held = row, []
            if kinds[i] < 0:
                part = data[ends[i] : ends[i + 1]]
                held.append((doc_ids[i], word_hashes(part, np.array([0, len(part)]))[0]))
                continue
            item = items[i].values.to_numpy().view(np.uint64)
            for doc_id, words in held:
                n, start, length = min((overlap(words, item, at) for at in offsets[i].values.to_pylist()), key=lambda x: (-x[0], x[1]))
                if n >= needed(len(item)):
                    out.append((row, doc_id, item_ids[i], n, start, length, len(item)))
        cols = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row", "doc_id", "item_id", "n_matched", "start_word", "n_overlap", "n_item_words"])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, counts = word_hashes(*strings(batch.column(1)))
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(words.view(np.int64)))], names=["item_id", "words"])


def row_key() -> Column:
    """One number for a row's id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_matched, start_word, n_overlap, n_item_words``: every item found in a document.

    An overlap has at least ``needed`` matching words and at least ``IDENTITY`` of its words match.
    """
    return matches(docs, benchmark).drop("row")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    own = unused(docs, "row")
    gone = small(matches(docs, benchmark).select(F.col("row").alias(own)).distinct())
    return docs.join(gone, row_key() == F.col(own), "left_anti")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """As ``contaminated``, with the ``row_key`` of the document's row."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("row", row_key())
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    items = cut(items.mapInArrow(_item_words, "item_id long, words array<long>").withColumn("item", F.monotonically_increasing_id()))
    tests = cut(items.select("item", "words").mapInArrow(_item_seeds, "h long, item long, item_at long"))
    short = tuple(sorted(r[0] for r in items.select(F.size("words")).where(F.size("words").between(1, SEED - 1)).distinct().collect()))
    # one bitmap for each of a few partitions, each of a fixed size, joined on the driver
    parts = tests.select("h").coalesce(8).mapInArrow(_bitmap, "bits binary").collect()
    bits = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for row in parts:
        bits |= np.frombuffer(bytes(row.bits), np.uint8)
    bitmap = spark.sparkContext.broadcast(bits.tobytes())
    found = cut(texts.select("row", "text").mapInArrow(_seeds(bitmap, short), "h long, row long, at long"))
    known = tests.join(found.groupBy("h").agg(F.count("*").alias("n")), "h")
    hits = hot_join(found, known, "h", "row", found.count()).select("row", "item", (F.col("at") - F.col("item_at")).alias("offset")).distinct()
    # offsets of an item in a text are no more than the words of both
    by_item = cut(hits.groupBy("row", "item").agg(F.collect_list("offset").alias("offsets")))
    words = items.join(by_item.groupBy("item").agg(F.count("*").alias("n")), "item")
    met = hot_join(by_item, words, "item", "row", by_item.count()).select("row", "item", "item_id", "offsets", "words")
    bodies = sieve(texts, by_item, "row").dropDuplicates(["row", "doc_id"]).select("row", F.lit(-1).cast("long").alias("item"), "doc_id", "text")
    rows = bodies.unionByName(met, allowMissingColumns=True).repartition("row").sortWithinPartitions("row", "item")
    return rows.mapInArrow(_measure, "row long, doc_id long, item_id long, n_matched long, start_word long, n_overlap long, n_item_words long")


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
