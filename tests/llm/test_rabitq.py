"""Embedding near-duplicates against brute force and SQL."""

from __future__ import annotations

import numpy as np
from oracle import DATA, connection, duck_rows, spark_rows

from stowage.llm import common, rabitq


def brute(rows, threshold=0.9):
    fine = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v):
            x = np.array(v, np.float32).astype(np.float64)
            x = x / np.abs(x).max()
            fine[i] = x / np.linalg.norm(x)
    root, links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fine)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i, _ in rows}


def result(df):
    rows = df.collect()
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    assert len(out) == len(rows)
    return out


def clusters(seed, n=30, size=12, dims=64):
    """Vectors around centres, at cosines from 0.8 to 1, and exact copies."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        c = rng.standard_normal(dims)
        for _ in range(size):
            out.append(c + rng.uniform(0, 0.5) * rng.standard_normal(dims))
        out.append(out[-1])
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(out)]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_brute_force(spark):
    for seed, dims in ((1, 64), (2, 100)):
        rows = clusters(seed, dims=dims)
        assert result(rabitq.near_vectors(table(spark, rows))) == brute(rows)


def test_small_blocks_count_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "BLOCK", 20)
    monkeypatch.setattr(rabitq, "PER_VALUE", 16)
    rows = clusters(3)
    assert result(rabitq.near_vectors(table(spark, rows))) == brute(rows)


def test_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, inf]), (6, [nan, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1e-30, 0.0]), (10, [1e30, 1e10]), (11, [-1.0, 0.0]), (12, [1.0, 0.0, 0.0]), (13, [1.0]), (14, [1.0, 0.0]), (15, [0.0, -0.0])]
    assert result(rabitq.near_vectors(table(spark, rows))) == brute(rows)
    assert rabitq.near_vectors(table(spark, [])).count() == 0
    more = table(spark, rows).selectExpr("*", "1 as v", "2 as rep", "3 as copies", "4 as n_links", "5 as component")
    assert result(rabitq.near_vectors(more)) == brute(rows)


def test_estimates_are_unbiased_and_bounded():
    """Averaged over rotations, estimates meet the inner products, and the bound fails hardly ever."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 128))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1:100] = 0.9 * x[0] + 0.436 * x[1:100]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true, off, errors, beyond, every = x @ x.T, ~np.eye(200, dtype=bool), [], 0, np.arange(200)
    for r in range(30):
        codes = rabitq.Codes(rabitq.Codes.encode(x, rabitq.ESTIMATES, rabitq.ESTIMATES * r), 128)
        about, margin = codes.estimate(every, every)
        errors.append(about - true)
        beyond += int((np.abs(about - true) > margin[:, None])[off].sum())
    assert abs(np.mean(errors, axis=0)[off]).mean() < 0.03
    assert abs(np.mean([e[off].mean() for e in errors])) < 0.003
    assert beyond / (30 * off.sum()) < 1e-4


def test_bounds_decide_what_is_computed_in_full():
    """Of pairs far from the threshold hardly any is computed, of links all are."""
    rng = np.random.default_rng(5)
    x = np.array([v for _, v in clusters(6, n=60, size=10)]) + 0.0
    far = rng.standard_normal((1000, 64))
    x = rabitq.unit(np.concatenate([x, far]))
    codes = rabitq.Codes(rabitq.Codes.encode(x, rabitq.ESTIMATES), 64)
    every = np.arange(len(x))
    got = [np.stack(p) for p in codes.pairs(every, every, True, 0.9)]
    i, j = np.concatenate(got, axis=1)
    tested = len(x) * (len(x) - 1) // 2
    assert len(i) < 0.01 * tested
    links = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    assert {tuple(p) for p in links.tolist()} <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_null_ids_and_shared_ids(spark):
    """Rows without an id whose vector no other row has, and an id with two vectors."""
    rows = [(None, [1.0, 0.0, 0.0]), (None, [0.99, 0.1, 0.0]), (None, [0.0, 1.0, 0.0]), (4, [0.99, 0.11, 0.0]), (4, [0.0, 0.0, 1.0]), (9, [0.0, 0.05, 1.0])]
    out = rabitq.near_vectors(table(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in out) == [(0, 0, 0, True), (0, 2, 4, False), (0, 2, 4, False), (4, 1, 4, True), (4, 2, 4, True), (9, 1, 4, False)]


def test_hot_vectors_and_values(spark, monkeypatch):
    """A third of all rows have one vector, and a third are near it."""
    monkeypatch.setattr(common, "HOT", 5)
    monkeypatch.setattr(rabitq, "BLOCK", 16)
    rng = np.random.default_rng(7)
    base = rng.standard_normal(64)
    rows = [(i, (base if i % 3 == 0 else base + 0.1 * rng.standard_normal(64) if i % 3 == 1 else rng.standard_normal(64)).astype(np.float32).tolist()) for i in range(300)]
    assert result(rabitq.near_vectors(table(spark, rows))) == brute(rows)


def test_bands_follow_the_number_of_vectors():
    assert rabitq.bands(10**9, 0.9)[0] > rabitq.bands(10**4, 0.9)[0]
    bits, count = rabitq.bands(10**6, 0.9)
    assert (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** count <= rabitq.MISS


def test_query_against_sql(spark):
    assert spark_rows(rabitq.op1_rotated_codes(spark, DATA)) == duck_rows(connection(), rabitq.ORACLE)
