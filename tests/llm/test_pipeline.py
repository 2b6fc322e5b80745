"""The stages in a row against brute force, each on what its predecessor kept."""

from __future__ import annotations

import random

import pytest
from test_linededup import brute as brute_lines
from test_minhash import brute as brute_near
from test_packing import check as check_packing
from test_spacedseed import exact

import corpus_pipeline
from stowage.llm import packing, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    """Tables with toxic documents, repeated lines, copies and benchmark passages, and clean documents."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(6) for _ in range(12)]
    items = [(j, text(30)) for j in range(10)]
    rows, kinds, labels = [], {}, []
    for i in range(300):
        kind = ("clean", "clean", "toxic", "lines", "copy", "leak")[i % 6]
        lines = [text(rng.randint(8, 20)) for _ in range(rng.randint(2, 8))]
        if kind == "toxic":
            lines[0] += " zorgon plimf zorgonish"
        elif kind == "lines":
            lines += shared
        elif kind == "copy" and i > 60:
            lines = rows[4 + 6 * rng.randrange(5)][1].split("\n")
            lines[-1] += " " + word()
        elif kind == "leak":
            lines.insert(1, items[i % 10][1])
        rows.append((i, "\n".join(lines)))
        kinds[i] = kind
        if i % 2:
            labels.append((i, 1, int(kind == "toxic")))
        elif kind == "toxic" or i % 4 == 0:
            labels.append((i, 1, int(kind == "toxic")))
    rows += [(1000, None), (1001, ""), (1002, "one two")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, kinds, items


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: r[0])


def test_every_stage_on_what_is_left(spark, folder):
    path, rows, kinds, items = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    left = stages["toxicity"](spark, docs, path)
    assert left.columns == docs.columns
    kept = pairs(left)
    assert [i for i, _ in kept] == [i for i, _ in rows if kinds.get(i) != "toxic"]
    assert all(dict(rows)[i] == t for i, t in kept)

    left = stages["line_dedup"](spark, left, path)
    assert left.columns == docs.columns
    expected = brute_lines(kept)
    kept = pairs(left)
    assert dict(kept) == {i: e[0] for i, e in expected.items()}
    assert sum(e[1] for e in expected.values()) > 40

    left = stages["near_dedup"](spark, left, path)
    assert left.columns == docs.columns
    groups = brute_near(kept, 80)
    before, kept = kept, pairs(left)
    assert kept == [(i, t) for i, t in before if groups[i][2]]
    assert len(kept) < len(before)

    left = stages["decontamination"](spark, left, path)
    assert left.columns == docs.columns
    leaks = {i for i, _ in exact([(i, t) for i, t in kept if t], items)}
    before, kept = kept, pairs(left)
    assert leaks
    assert kept == [(i, t) for i, t in before if i not in leaks]

    check_packing(kept, stages["packing"](spark, left, path).collect(), packing.BUDGET, packing.BUCKETS)
    run = corpus_pipeline.run(spark, path)
    check_packing(kept, run.collect(), packing.BUDGET, packing.BUCKETS)


def test_nulls_repeated_ids_clashing_columns_and_long_texts(spark, folder, tmp_path):
    """Every stage keeps the columns of its input, and what it decides holds for rows without ids too."""
    path = folder[0]
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))
    own, other, long = text(60), text(60), text(40_000)
    item = spark.read.parquet(f"{path}/benchmark.parquet").first().text
    rows = [(1, own), (1, own), (1, other), (2, own), (None, own), (None, text(50)), (None, None), (3, None), (4, ""), (5, long), (6, f"{text(20)} {item}"), (None, f"{text(20)} {item}"), (7, " zorgon plimf zorgonish" * 3)]
    docs = spark.createDataFrame([(i, t, None, "s", None, 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row long, _gone long, _id long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = left.columns
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == columns, name
        left = left.checkpoint()
    got = sorted(((r.doc_id or 0, r.text) for r in left.collect()), key=str)
    assert got == sorted([(0, next(t for i, t in rows[5:6])), (0, None), (1, own), (1, other), (3, None), (4, ""), (5, long), (7, rows[-1][1])], key=str)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= len(got)


def test_session_settings_stay(spark, folder):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    corpus_pipeline.STAGES[2][1](spark, spark.read.parquet(f"{folder[0]}/documents.parquet"), folder[0]).count()
    assert spark.conf.get(key) == before


def test_empty_tables(spark, folder, tmp_path):
    path = folder[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_whole_tables(spark):
    """Toxic documents go as the model says; everything else is decided by the stages above."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).collect() if r.toxic}
    assert out
    assert not out & toxic
