"""Helpers that operators share."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.llm import common


def test_a_sieve_broadcasts_bits(spark, monkeypatch):
    """What goes through the driver is a row for 64 marks, and the rows that pass are those whose mark a right key has."""
    sent, send = [], F.broadcast
    monkeypatch.setattr(common, "MARKS", 1 << 10)
    monkeypatch.setattr(common.F, "broadcast", lambda df: sent.append(df) or send(df))
    left = spark.range(-3000, 3000).selectExpr("id as key", "id * 2 as x")
    for n in (0, 1, 40, 900, 5000):
        right = spark.range(n).selectExpr("7 * id as key", "id as _x")
        out = common.sieve(left, right, "key")
        marks = {r[0] for r in right.select(F.expr(f"pmod(xxhash64(key), {common.MARKS})")).collect()}
        assert out.columns == ["key", "x"]
        assert sorted(map(tuple, out.collect())) == [(r.key, r.x) for r in left.withColumn("mark", F.expr(f"pmod(xxhash64(key), {common.MARKS})")).orderBy("key").collect() if r.mark in marks]
        assert sent.pop().count() <= common.MARKS // 64
