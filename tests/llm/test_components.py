"""Connected components against union-find."""

from __future__ import annotations

import random

from stowage.llm import common, components
from stowage.llm.components import connected_components


def expected(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def check(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    rows = connected_components(df).collect()
    got = {r.node: r.component for r in rows}
    assert len(rows) == len(got)
    assert got == expected(edges)


def test_chains_stars_loops_and_nulls(spark):
    check(spark, [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(2000, 2300)] + [(5000, 5000), (None, 3), (7000, -3), (-3, 7001)])


def test_random_graph(spark):
    rng = random.Random(3)
    check(spark, [(rng.randint(0, 900), rng.randint(0, 900)) for _ in range(400)])


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_of_stars(spark, monkeypatch):
    """More edges than one task may have, and nodes that count as hot."""
    monkeypatch.setattr(components, "CHUNK", 3)
    monkeypatch.setattr(common, "HOT", 20)
    rng = random.Random(4)
    check(spark, [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(0, i) for i in range(300, 500)] + [(i, i + 1) for i in range(600, 700)])


def test_rounds_are_small_plans_and_end_early(spark, monkeypatch):
    """The driver never plans a whole round at once, and what fits into one task after a round goes there."""
    plans, counts = [], []
    work, state = components.cut, components._state
    monkeypatch.setattr(components, "CHUNK", 150)
    monkeypatch.setattr(components, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or work(df))
    monkeypatch.setattr(components, "_state", lambda edges: counts.append(state(edges)) or counts[-1])
    check(spark, [(7 * i % 100, 7 * (i + k) % 100) for i in range(100) for k in (1, 2, 3)])
    assert counts[0][0] > 150 >= counts[-1][0]
    assert all(n[0] > 150 for n in counts[:-1])
    assert max(p.count("Join ") for p in plans) <= 2
