"""Length buckets against an exhaustive search, and the law of batches."""

from __future__ import annotations

import itertools
import random
from functools import lru_cache

import numpy as np
import public_tokenizers
from oracle import DATA
from tokenizers import Tokenizer

from stowage.llm import packing
from stowage.llm.bpe import TOKENIZER


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


def best(lengths, buckets):
    steps = sorted(set(lengths))
    return min(padding(lengths, (*c, steps[-1])) for k in range(min(buckets, len(steps))) for c in itertools.combinations(steps[:-1], k))


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for buckets in (1, 2, 3, 4):
        for _ in range(10):
            lengths = [rng.randint(0, 30) for _ in range(rng.randint(1, 40))]
            steps = sorted(set(lengths))
            count = np.array([lengths.count(s) for s in steps])
            bounds = packing.boundaries(np.array(steps), count, buckets)
            assert len(bounds) <= buckets
            assert padding(lengths, bounds) == best(lengths, buckets)


@lru_cache(maxsize=1)
def library():
    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def tokens(text):
    return len(library().encode(text, add_special_tokens=False).ids) if text else 0


def check(texts, out, budget, buckets):
    lengths = {i: tokens(t) for i, t in texts}
    assert sorted(r.doc_id for r in out) == sorted(lengths)
    batches = {}
    for r in out:
        assert r.n_tokens == lengths[r.doc_id]
        assert r.padding == r.bucket_length - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    assert len({r.bucket for r in out}) <= buckets
    for (bucket, _), rows in batches.items():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len({r.bucket_length for r in rows}) == 1
        assert len(rows) == 1 or len(rows) * max(1, rows[0].bucket_length) <= budget
    for bucket in {b for b, _ in batches}:
        numbers = sorted(n for b, n in batches if b == bucket)
        assert numbers == list(range(len(numbers)))
        room = max(1, budget // max(1, batches[bucket, 0][0].bucket_length))
        assert all(len(batches[bucket, n]) == room for n in numbers[:-1])
    return sum(r.padding for r in out)


def test_small_table_has_the_least_padding(documents):
    rng = random.Random(2)
    texts = [(i, " ".join(["w"] * rng.choice([0, 1, 2, 3, 5, 8, 13, 21, 34]))) for i in range(300)]
    out = packing.pack(documents(texts), n_buckets=4, budget=64).collect()
    assert check(texts, out, 64, 4) == best([tokens(t) for _, t in texts], 4)


def test_long_lengths_are_exact(documents, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 10)
    rng = random.Random(3)
    texts = [(i, " w" * rng.choice([3, 1100, 1101, 1203, 2000, 2001, 2017, 4999])) for i in range(200)]
    out = packing.pack(documents(texts), n_buckets=3, budget=8000).collect()
    assert check(texts, out, 8000, 3) == best([tokens(t) for _, t in texts], 3)


def test_rows_without_ids(documents, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 10)
    out = packing.pack(documents([(None, "w w"), (7, "w w")] * 40), n_buckets=2, budget=10).collect()
    room = {r.batch: 0 for r in out}
    for r in out:
        room[r.batch] += 1
    assert sorted(room) == list(range(len(room)))
    assert set(room.values()) == {10 // out[0].bucket_length}


def test_edge_cases(documents):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "w " * 70_000), (6, "a"), (7, "a")]
    check(texts, packing.pack(documents(texts)).collect(), packing.BUDGET, packing.BUCKETS)
    assert packing.pack(documents([])).count() == 0
    more = documents(texts).selectExpr("*", "1 as bucket", "2 as chunk", "3 as n_tokens", "4 as batch")
    check(texts, packing.pack(more).collect(), packing.BUDGET, packing.BUCKETS)


def test_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    check(texts, packing.op9_length_buckets(spark, DATA).collect(), packing.BUDGET, packing.BUCKETS)
