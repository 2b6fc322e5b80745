"""Near-duplicates against brute force and SQL."""

from __future__ import annotations

import random
import re

import pytest
from oracle import DATA, connection, duck_rows, spark_rows

from stowage.llm import common, minhash, setjoin


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)}


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def result(df):
    rows = df.collect()
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert len(out) == len(rows)
    return out


def variants(seed, groups=12, words=300):
    """Texts of which some are near copies, at similarities on both sides of the threshold."""
    rng, rows, n = random.Random(seed), [], 0
    for _ in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
        for changes in (0, 0, 1, 3, 6, 10, 20):
            own = list(base)
            for k in rng.sample(range(words), changes):
                own[k] = f"x{rng.randint(0, 10**6)}"
            rows.append((n, " ".join(own)))
            n += 1
    return rows


def test_brute_force_at_both_sides_of_the_threshold(documents):
    rows = variants(1)
    for percent in (80, 85):
        assert result(minhash.near_duplicates(documents(rows), percent)) == brute(rows, percent)


def test_edge_cases(documents):
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one  TWO"), (5, "one two three"), (6, "É É É É É É"), (7, "é é é é é é"), (8, "a b c d e"), (9, "A B c d e"), (10, "a b c d e"), (11, "x " * 20_000), (12, "x " * 10)]
    assert result(minhash.near_duplicates(documents(rows), 85)) == brute(rows, 85)


def test_empty_table_and_extra_columns(documents):
    assert minhash.near_duplicates(documents([])).count() == 0
    df = documents([(1, "a b c d e f"), (2, "a b c d e f")]).selectExpr("*", "1 as rep", "2 as component_id", "3 as kept", "'x' as signature")
    assert result(minhash.near_duplicates(df)) == {1: (2, 1, True), 2: (2, 1, False)}


def test_large_group_of_near_copies(documents, monkeypatch):
    """Blocks are small here, so that one group is dealt to many cells."""
    monkeypatch.setattr(setjoin, "BLOCK", 16)
    monkeypatch.setattr(setjoin, "CELL_BYTES", 20_000)
    monkeypatch.setattr(common, "HOT", 10)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        own = list(base)
        own[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(own)))
    assert result(minhash.near_duplicates(documents(rows), 85)) == brute(rows, 85)


def test_chains_need_more_than_the_pivots(documents, monkeypatch):
    """Texts that drift away from the first one, a few words at a time, beside a group that does not."""
    monkeypatch.setattr(setjoin, "BLOCK", 8)
    rng = random.Random(3)
    rows = []
    for start in (0, 1000):
        own = [f"w{start}_{i}" for i in range(200)]
        for i in range(60):
            for k in rng.sample(range(200), 2):
                own[k] = f"x{start}_{i}_{k}"
            rows.append((start + i, " ".join(own)))
    base = rows[20][1].split()
    for i in range(40):
        own = list(base)
        own[rng.randrange(200)] = f"y{i}"
        rows.append((2000 + i, " ".join(own)))
    rng.shuffle(rows)
    for percent in (80, 90):
        assert result(minhash.near_duplicates(documents(rows), percent)) == brute(rows, percent)


def test_rows_without_ids_and_rows_that_share_one(documents):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = minhash.near_duplicates(documents([(None, a), (None, b), (5, a), (5, b), (3, b), (None, "z y x"), (None, "z y x")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (0, 0, True), (0, 3, False), (0, 5, False), (3, 3, True), (5, 3, False), (5, 5, True)]


def test_threshold_of_matches():
    assert minhash.match_threshold(0.85) < 0.85 * minhash.COORDINATES
    assert minhash.match_threshold(0.01) == 1


def test_query_against_sql(spark):
    assert spark_rows(minhash.op8_minhash_inverted_join(spark, DATA)) == duck_rows(connection(), minhash.ORACLE)


@pytest.mark.parametrize("seed", [5, 6])
def test_no_link_is_lost_over_seeds(documents, seed):
    rows = variants(seed, groups=6, words=80)
    assert result(minhash.near_duplicates(documents(rows), 85)) == brute(rows, 85)


def test_posts_are_not_joined_to_find_hot_ones(spark, monkeypatch):
    """A hot list deals its posts to buckets by a test of the key: the only join of posts is with those that others have."""
    rows = [(i, [7] * 40 + list(range(100 * i, 100 * i + 24))) for i in range(30)]
    classes = spark.createDataFrame(rows, "member long, signature array<int>")
    monkeypatch.setattr(common, "HOT", 100)
    out = minhash.prefixes(classes, 24, 30)
    assert "LeftOuter" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.list >> 32, r.list & 0xFFFFFFFF, r.member) for r in out.collect()) == [(k, 7, i) for k in range(17) for i in range(30)]


def test_links_leave_no_python_step_to_others(spark):
    """What follows in the same tasks would need workers of its own: a forest is computed before it is given on."""
    base = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join([*base[:59], f"x{i}"])) for i in range(4)]
    bodies = spark.createDataFrame(texts, "member long, text string")
    lists = spark.createDataFrame([(1, i) for i, _ in texts], "list long, member long")
    found = setjoin.links(lists, bodies.selectExpr("member", "56 as size"), lambda wanted: bodies.join(wanted, "member"), 80)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted({x for r in found.collect() for x in (r.u, r.v)}) == [0, 1, 2, 3]


@pytest.mark.parametrize("hot", [1000, 4])
def test_joins_by_key_have_one_form(spark, monkeypatch, hot):
    """With hot keys or without, all joins are on the key alone, and the rows are the same."""
    monkeypatch.setattr(common, "HOT", hot)
    left = spark.createDataFrame([(k % 3 if k % 2 else k, k) for k in range(60)], "key long, member long")
    right = left.groupBy("key").count().selectExpr("key", "key * 7 as x", "count as n")
    out = common.key_join(left, right, "key", 60)
    assert "_salt" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == sorted((k, i, 7 * k) for k, i in map(tuple, left.collect()))
