"""Streams of events and of files."""

from __future__ import annotations

from stowage.streaming.progress import running_totals, upload_progress, watch_listing

SCHEMA = "event string, key string, bytes long"
FIRST = [("object_upload_starting", "a", 10), ("object_part_uploaded", "a", 4), ("object_part_uploaded", "b", 3)]
SECOND = [("object_part_uploaded", "a", 6), ("object_upload_starting", "b", 5), ("object_upload_starting", "c", 0)]


def run(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def source(spark, tmp_path):
    for i, rows in enumerate((FIRST, SECOND)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "events" / f"n={i}"))
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))


def test_progress_of_uploads(spark, tmp_path):
    rows = run(spark, upload_progress(source(spark, tmp_path)), "uploads", "update")
    last = {}
    for r in rows:
        if r.key not in last or r.uploaded >= last[r.key].uploaded:
            last[r.key] = r
    assert (last["a"].uploaded, last["a"]["size"], last["a"].done) == (10, 10, True)
    assert (last["b"].uploaded, last["b"].n_parts) == (3, 1)
    assert last["c"].done


def test_totals_agree_with_the_batch(spark, tmp_path):
    rows = run(spark, running_totals(source(spark, tmp_path)), "totals", "complete")
    assert {r.event: (r.n, r.n_bytes) for r in rows} == {"object_upload_starting": (3, 15), "object_part_uploaded": (3, 13)}


def test_new_files(spark, tmp_path):
    (tmp_path / "in" / "x").mkdir(parents=True)
    (tmp_path / "in" / "x" / "f").write_bytes(b"abc")
    rows = run(spark, watch_listing(spark, str(tmp_path / "in")), "files", "append")
    assert [(r.key.rsplit("/", 1)[-1], r["size"]) for r in rows] == [("f", 3)]
