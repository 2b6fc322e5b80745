"""Chunks of lines against brute force and SQL."""

from __future__ import annotations

import hashlib
import random

from oracle import DATA, connection, duck_rows, spark_rows

from stowage.llm import linededup


def full(line):
    return line.strip(" \t\v\f\r") != ""


def cut(text):
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if full(x)]
    if len(at) < 2:
        return [lines]
    hashes = [int(hashlib.md5(lines[i].encode()).hexdigest()[:8], 16) for i in at]
    rolling = [(h * 31 + (hashes[k - 1] if k else 0)) % linededup.PRIME for k, h in enumerate(hashes)]
    starts = [0]
    for k in range(2, len(at) - 1):
        before, here, after = rolling[k - 1 : k + 2]
        if here < before and here <= after or k % 2 == 0 and rolling[k - 2] == before == here == after:
            starts.append(at[k])
    return [lines[a:b] for a, b in zip(starts, [*starts[1:], len(lines)], strict=True)]


def brute(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[i] = (None, 0, 0)
            continue
        left, chunks, lines = [], 0, 0
        for own in cut(text):
            body = "\n".join(own)
            if sum(map(full, own)) >= 2:
                if body in seen:
                    chunks, lines = chunks + 1, lines + len(own)
                    continue
                seen.add(body)
            left += own
        out[i] = ("\n".join(left), chunks, lines)
    return out


def result(df):
    return {r.doc_id: (r.text, r.n_chunks_removed, r.n_lines_removed) for r in df.collect()}


def made(seed, n=60):
    rng = random.Random(seed)
    passages = [[f"line {rng.randint(0, 10**9)}" for _ in range(rng.randint(3, 14))] for _ in range(8)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(rng.randint(0, 4)):
            own += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(["", " ", "x", f"own {rng.random()}"]) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(own)))
    return rows


def test_brute_force(documents):
    for seed in (1, 2):
        rows = made(seed)
        assert result(linededup.dedup_lines(documents(rows))) == brute(rows)


def test_passages_are_found_at_other_offsets(documents):
    passage = [f"the passage, line {k}" for k in range(40)]
    rows = [(1, "\n".join(["head", *passage, "tail"])), (2, "\n".join(["other", "lines", "before", *passage, "and after"]))]
    text, chunks, lines = result(linededup.dedup_lines(documents(rows)))[2]
    assert lines >= 25
    assert chunks >= 1
    assert text.startswith("other\nlines\nbefore")
    assert text.endswith("and after")


def test_a_copy_loses_all_its_lines(documents):
    rng = random.Random(5)
    text = "\n".join(rng.choice(["", f"line {rng.random()}", f"line {rng.random()}", "again", "\t", "x"]) for _ in range(4000))
    out = result(linededup.dedup_lines(documents([(1, text), (2, text)])))
    repeated_inside = out[1][2]
    assert out[2] == ("", len(cut(text)), 4000)
    assert repeated_inside < 2000


def test_runs_of_equal_lines(documents):
    rows = [(i, "\n".join([f"a{i}", f"b{i}", f"c{i}"][: 1 + i % 3] + ["the same again"] * (20 + i) + [f"d{i}", f"e{i}"])) for i in range(6)]
    out = result(linededup.dedup_lines(documents(rows)))
    assert out == brute(rows)
    assert all(n >= 12 for _, _, n in out.values())


def test_share_of_a_passage_that_goes(documents):
    """Lines of a passage between others, but for those near its ends."""
    rng = random.Random(6)
    for n, share in ((8, 0.4), (16, 0.7), (40, 0.85)):
        rows = []
        for i in range(100):
            passage = [f"line {n} {i} {k}" for k in range(n)]
            for j in (0, 1):
                own = [f"own {rng.random()}" for _ in range(rng.randint(3, 9))]
                rows.append((2 * i + j, "\n".join([*own, *passage, f"own {rng.random()}", f"own {rng.random()}"])))
        removed = sum(r[2] for r in result(linededup.dedup_lines(documents(rows))).values())
        assert removed / (100 * n) > share


def test_edge_cases(documents):
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, "a"), (5, "a"), (6, "a\nb\nc\nd\ne\nf\ng\nh"), (7, "a\nb\nc\nd\ne\nf\ng\nh"), (8, "ü\r\nß\t\n" * 3000)]
    assert result(linededup.dedup_lines(documents(rows))) == brute(rows)
    assert linededup.dedup_lines(documents([])).count() == 0


def test_columns_stay_and_lengths_follow(documents):
    rows = [(1, "\n".join(f"l{k}" for k in range(30))), (2, "\n".join(f"l{k}" for k in range(30)))]
    df = documents(rows).selectExpr("*", "7 as h", "8 as chunk", "9 as n_lines_removed", "'y' as body", "'z' as _gone2")
    out = linededup.dedup_lines(df)
    assert out.columns == [*(c for c in df.columns if c != "n_lines_removed"), "n_chunks_removed", "n_lines_removed"]
    for r in out.collect():
        assert (r.h, r.chunk, r.body) == (7, 8, "y")
        assert r.n_chars == len(r.text)


def test_no_python_on_the_main_path(spark):
    plan = linededup.op7_line_chunks(spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


def test_query_against_sql(spark):
    assert spark_rows(linededup.op7_line_chunks(spark, DATA)) == duck_rows(connection(), linededup.ORACLE)
