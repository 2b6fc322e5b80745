"""Nulls in any column and repeated rows, for every operator."""

from __future__ import annotations

import public_tokenizers
import pytest

from stowage.llm import bpe, histsort, linededup, minhash, packing, pages, paragraphs, rabitq, spacedseed, toxicity

LINES = "\n".join(f"a line of words number {k} and more" for k in range(30))


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated rows, a repeated id, null ids, texts and other columns."""
    rows = [(1, LINES, "en", "s", 5), (1, LINES, "en", "s", 5), (1, "other text", None, None, None), (2, LINES, None, "s", None), (None, LINES, "en", None, 1), (None, None, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_minhash(docs):
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == 8
    assert sorted(r.component_id for r in rows if r.doc_id is not None) == [1, 1, 1, 1, 3, 4]
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_linededup(docs):
    rows = linededup.dedup_lines(docs).collect()
    assert len(rows) == 8
    assert sum(r.text is None for r in rows) == 2
    assert [r.text for r in rows if r.doc_id == 1 and r.lang is None] == ["other text"]
    assert [r.n_lines_removed for r in rows if r.doc_id is None] == [0, 0]


def test_linededup_tells_rows_of_one_id_apart(spark):
    """The second text of an id has, at the same place, lines that stand nowhere else."""
    own = "\n".join(f"this line is only here {k}" for k in range(30))
    rows = [(1, LINES), (2, LINES), (2, own), (2, LINES)]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in out if r.n_lines_removed == 0) == sorted([LINES, own])
    assert sum(r.n_lines_removed > 0 for r in out) == 2


def test_paragraphs(docs):
    assert {r.doc_id for r in paragraphs.repeated_passages(docs).collect()} >= {1, 2}


def test_bpe(docs):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        assert bpe.count_tokens(docs, f.read()).count() == 8


def test_histsort(docs):
    rows = histsort.assign(docs).collect()
    assert len(rows) == 8
    for s in range(16):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_packing(docs):
    assert packing.pack(docs).count() == 8


def test_spacedseed(spark, docs):
    items = spark.createDataFrame([(1, LINES), (None, LINES), (2, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in spacedseed.contaminated(docs, items).collect()}
    assert {(1, 1), (2, 1)} <= got


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (3, None, None), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == 8
    assert toxicity.reject_toxic(docs, model).count() == sum(not r.toxic for r in scored)


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], None), (2, None, 1), (3, [1.0, 0.1], None)]
    out = rabitq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(out) == 5
    assert sorted(r.component_id for r in out if r.vec_id is not None) == [1, 1, 1, 2]
    assert {r.n_links for r in out if r.vec_id != 2} == {3}


def test_pages(spark):
    rows = [(1, None, "<article><p>Some words of text.</p></article>"), (None, "u", None), (1, None, "<p>x"), (1, None, "<p>x")]
    assert pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).count() == 4
