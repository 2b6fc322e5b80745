"""Every registered query against its SQL."""

from __future__ import annotations

import pytest
from oracle import DATA, connection, duck_rows, spark_rows

from stowage.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, con, name):
    assert name in ORACLES
    columns, got = spark_rows(QUERIES[name](spark, DATA))
    expected_columns, expected = duck_rows(con, ORACLES[name])
    assert columns == expected_columns
    assert len(got) == len(expected)
    assert got == expected


def test_queries_have_rows(spark):
    """No comparison is with an empty table, but for those that select what the smallest tables lack."""
    for name in ("select_prefix", "select_object", "select_glob_star", "select_glob_recursive", "select_glob_class", "select_glob_question", "filter_glob", "filter_exact", "upload_parts"):
        assert QUERIES[name](spark, DATA).count(), name


def test_damage_is_seen(spark):
    """Checks have both outcomes on the damaged parts and logs."""
    assert {r.contiguous for r in QUERIES["parts_contiguity"](spark, DATA).collect()} == {True, False}
    assert {r.complete for r in QUERIES["parts_complete"](spark, DATA).collect()} == {True, False}
    assert {r.holds for r in QUERIES["event_reconcile"](spark, DATA).collect()} == {True, False}
    assert QUERIES["event_mismatches"](spark, DATA).count()
    assert QUERIES["event_uniqueness"](spark, DATA).count()
