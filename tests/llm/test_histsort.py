"""Shards of equal bytes: the law, slots and edge cases."""

from __future__ import annotations

import random
import zlib

import pytest
from oracle import DATA

from stowage.llm import histsort


def check(rows, out, shards=16, slack=0):
    """The law ``bytes``: shards differ by twice the tolerance or by the largest rows."""
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in rows)
    texts = dict(rows)
    total, slots = [0] * shards, [[] for _ in range(shards)]
    for r in out:
        text = texts[r.doc_id]
        assert r["size"] == len((text or "").encode()) + 1
        assert r.text_crc32 == zlib.crc32((text or "").encode())
        total[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    for s in slots:
        assert sorted(s) == list(range(len(s)))
    largest = max((len((t or "").encode()) + 1 for _, t in rows), default=0)
    assert max(total) - min(total) <= 2 * max(histsort.TOLERANCE * sum(total) / shards, 1) + 2 * largest + slack
    return total


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    out = histsort.op3_histogram_sort(spark, DATA)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = out.collect()
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    check(rows, got)


def test_many_parts_of_a_shard(documents, monkeypatch):
    monkeypatch.setattr(histsort, "PART_ROWS", 20)
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 40)) for i in range(3000)]
    check(rows, histsort.assign(documents(rows)).collect())


def test_one_text_holds_most_rows(documents):
    """A hot text is cut inside by doc_id, and shards stay equal."""
    rows = [(i, "the same text") for i in range(2000)] + [(i, f"other {i}") for i in range(2000, 2600)]
    check(rows, histsort.assign(documents(rows)).collect())


def test_rows_that_share_text_and_id_are_cut(documents):
    """A third of all rows have one text and no id: only their stored numbers tell them apart."""
    out = histsort.assign(documents([(None, "the same text")] * 400 + [(i, f"other text {i}") for i in range(800)]), shards=4).collect()
    total = [sum(r["size"] for r in out if r.shard == s) for s in range(4)]
    assert max(total) - min(total) <= 0.004 * sum(total) / 4 + 40
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_equal_texts_are_neighbours(documents):
    rows = [(i, f"text {i % 300}") for i in range(1200)]
    out = histsort.assign(documents(rows)).collect()
    shards = {}
    for r in out:
        shards.setdefault(r.text, set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 15
    for r in out:
        assert max(shards[r.text]) - min(shards[r.text]) <= 1


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a"), (2, None), (3, "")], [(5, "long " * 5000), *((i, "s") for i in range(6, 60))]])
def test_edge_cases(documents, rows):
    out = histsort.assign(documents(rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.shard < 16
    for s in range(16):
        own = sorted(r.slot for r in out if r.shard == s)
        assert own == list(range(len(own)))


def test_repeated_ids_and_clashing_columns(documents):
    df = documents([(1, "a"), (1, "a"), (1, "b"), (-5, "c")]).selectExpr("*", "9 as size", "9 as shard", "8 as slot", "7 as n", "6 as h")
    out = histsort.assign(df).collect()
    assert sorted(r["size"] for r in out) == [2, 2, 2, 2]
    assert {(r.n, r.h) for r in out} == {(7, 6)}


def test_written_shards(documents, spark, tmp_path):
    rows = [(i, "x" * (i % 30)) for i in range(500)]
    histsort.write_shards(documents(rows), str(tmp_path / "out"))
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(500))
