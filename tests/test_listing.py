"""Listings of folders."""

from __future__ import annotations

import pytest

from stowage.functions.selectors import Selector, scopes
from stowage.model import UnsupportedStore
from stowage.sources.catalog import list_bucket
from stowage.sources.listing import _Reader


@pytest.fixture
def root(tmp_path):
    for key, n in {"a": 3, "empty": 0, ".hidden": 1, "_under/x": 2, "en/b/c.txt": 5, "en/b/d/e.txt": 6, "en/f": 0, "fr/g%20 ü": 7}.items():
        path = tmp_path / "bucket" / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * n)
    return tmp_path / "bucket"


def test_everything_is_listed(spark, root):
    rows = list_bucket(spark, str(root)).collect()
    assert {r.key: r["size"] for r in rows} == {"a": 3, "empty": 0, ".hidden": 1, "_under/x": 2, "en/b/c.txt": 5, "en/b/d/e.txt": 6, "en/f": 0, "fr/g%20 ü": 7}
    assert {r.bucket for r in rows} == {"bucket"}
    assert all(r.timestamp.timestamp() == pytest.approx((root / r.key).stat().st_mtime, abs=1e-5) for r in rows)
    assert all(r.path == f"{root}/{r.key}" for r in rows)


@pytest.mark.parametrize(("text", "keys"), [("en/", ["en/f"]), ("en/b/*.txt", ["en/b/c.txt"]), ("en/**", ["en/b/c.txt", "en/b/d/e.txt", "en/f"]), ("en/f", ["en/f"]), ("nothing/x/*", [])])
def test_selectors_narrow_the_listing(spark, root, text, keys):
    assert sorted(r.key for r in list_bucket(spark, str(root), Selector.parse(text)).collect()) == keys


def test_options_decide_where_the_listing_begins(root):
    paths = lambda **o: [p.path for p in _Reader({"path": str(root), **o}).partitions()]
    assert paths(prefix="en/b/c") == [f"{root}/en/b", f"{root}/en/b/d"]
    assert paths(prefix="en/", direct="true") == [f"{root}/en"]
    assert paths(key="en/f") == [f"{root}/en/f"]


def test_a_single_object_is_looked_up(spark, root):
    assert [(r.key, r["size"]) for r in list_bucket(spark, str(root), Selector.parse("en/b/c.txt")).collect()] == [("en/b/c.txt", 5)]
    assert list_bucket(spark, str(root), Selector.parse("en/b")).count() == 0


def test_scopes_list_nothing_twice():
    names = lambda *texts: [(s.kind, s.value) for s in scopes([Selector.parse(t) for t in texts])]
    assert names("a/b", "a/", "a/**/x", "c/d", "c/") == [("below", "a/"), ("prefix", "c/")]
    assert names("x*", "xy/z*", "w") == [("below", "x"), ("object", "w")]
    assert names("q", None) == [("bucket", None)]


def test_missing_folder_and_unknown_store(spark, tmp_path):
    assert list_bucket(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(UnsupportedStore):
        list_bucket(spark, "gs://bucket")
