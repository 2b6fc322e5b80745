"""Archives: written by Spark, read by an independent reader, and the other way round."""

from __future__ import annotations

import hashlib
import io
import json
import pickle
import random
import tarfile
from pathlib import Path

import pytest

from stowage import api
from stowage.api import check_path, create_archive, extract_archive, list_archive, split_input
from stowage.functions.selectors import EntryFilter
from stowage.model import ArchiveNotFound, Config, CorruptArchive, EmptyArchive, InvalidKey, NoInputs, NothingMatched, ObjectNotFound, StowageError
from stowage.operators import events
from stowage.plans.index import archive_index, archive_totals, check_keys
from stowage.sources import tar
from stowage.sources.tar import headers

KIB = 1024


def put(root: Path, objects: dict[str, bytes]) -> None:
    for key, data in objects.items():
        path = root / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def contents(path: Path) -> dict[str, str]:
    with tarfile.open(path) as tar:
        return {m.name: hashlib.sha256(tar.extractfile(m).read()).hexdigest() for m in tar.getmembers()}


def digests(objects: dict[str, bytes]) -> dict[str, str]:
    return {k: hashlib.sha256(v).hexdigest() for k, v in objects.items()}


def below(root: Path) -> dict[str, str]:
    return {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in root.rglob("*") if p.is_file()}


@pytest.fixture(scope="module")
def objects():
    rng = random.Random(5)
    sizes = {"zero": 0, "small": 10, "at/threshold": 8 * KIB, "below": 8 * KIB - 1, "above/deep": 8 * KIB + 1, "large": 50 * KIB, "ü/ä ö%20.txt": 700, "block": 512}
    sizes |= {f"long/{'x' * (n - 9)}.txt": n for n in (99, 100, 101)}
    sizes |= {f"l/{'y' * 200}/{'z' * (n - 203)}": 3 for n in (255, 300, 400)}
    return {k: rng.randbytes(n) for k, n in sizes.items()}


@pytest.fixture(scope="module")
def store(tmp_path_factory, objects):
    root = tmp_path_factory.mktemp("bucket")
    put(root, objects)
    return root


SMALL = Config(multipart_chunk_size="8KiB", multipart_threshold="8KiB")


def test_create_and_read_with_tarfile(spark, store, objects, tmp_path):
    target, told = tmp_path / "a.tar", {}
    done = create_archive(spark, [str(store)], str(target), SMALL, progress=lambda event, **v: told.update({event: v}))
    assert contents(target) == digests(objects)
    assert done.n_objects == len(objects)
    assert done.n_bytes == sum(map(len, objects.values()))
    assert done.archive_bytes == target.stat().st_size
    assert told["archive_writes_completed"]["total_bytes_written"] == done.archive_bytes
    assert [p.name for p in tmp_path.iterdir()] == ["a.tar"]


def test_index_agrees_with_tarfile(spark, store, objects, tmp_path):
    target = tmp_path / "a.tar"
    create_archive(spark, [str(store)], str(target), SMALL)
    with tarfile.open(target) as tar:
        there = {m.name: (m.offset, m.offset_data, m.size) for m in tar.getmembers()}
    with target.open("rb") as f:
        own = {e.key: (e.header_offset, e.data_offset, e.size) for e in headers(f)}
    assert own == there
    rows = spark.createDataFrame([("b", k, None, len(v), 0) for k, v in objects.items()], "bucket string, key string, version_id string, size long, t long")
    rows = rows.selectExpr("bucket", "key", "version_id", "size", "timestamp_seconds(t) as timestamp")
    index = archive_index(rows).collect()
    assert {r.key: r.data_offset - r.header_offset for r in index} == {k: b - a for k, (a, b, _) in there.items()}
    assert archive_totals(rows).first().archive_bytes == target.stat().st_size


def test_several_inputs_each_object_once(spark, store, objects, tmp_path):
    target = tmp_path / "a.tar"
    create_archive(spark, [f"{store}//small", f"{store}//long/", f"{store}//**/*.txt", f"{store}//s*"], str(target), SMALL)
    expected = {k: v for k, v in objects.items() if k == "small" or k.endswith(".txt")}
    assert contents(target) == digests(expected)


def test_errors(spark, store, tmp_path):
    target = str(tmp_path / "a.tar")
    with pytest.raises(NoInputs):
        create_archive(spark, [], target)
    with pytest.raises(NothingMatched):
        create_archive(spark, [f"{store}//small", f"{store}//nothing/**"], target)
    with pytest.raises(ObjectNotFound):
        create_archive(spark, [f"{store}//nothing"], target, allow_empty=True)
    with pytest.raises(NothingMatched):
        create_archive(spark, [f"{store}//nothing/"], target, allow_empty=True)
    with pytest.raises(EmptyArchive):
        from stowage.plans.create import check_plan

        check_plan(spark.createDataFrame([], "key string"))
    assert not list(tmp_path.iterdir())


def test_empty_archive(spark, store, tmp_path):
    target = tmp_path / "a.tar"
    done = create_archive(spark, [f"{store}//nothing/**"], str(target), allow_empty=True)
    assert done.n_objects == 0
    assert target.read_bytes() == b"\0" * 1024
    assert extract_archive(spark, str(target), f"{tmp_path}/out/").extracted_objects == 0


def test_bad_keys(spark):
    for key in ("", "/a", "a/../b", ".."):
        with pytest.raises(InvalidKey):
            check_keys(spark.createDataFrame([(key,), ("fine..txt",)], "key string"))
    check_keys(spark.createDataFrame([("a..b",), ("...",)], "key string"))


@pytest.fixture(scope="module")
def archive(tmp_path_factory, objects):
    path = tmp_path_factory.mktemp("archives") / "by-tarfile.tar"
    with tarfile.open(path, "w", format=tarfile.GNU_FORMAT) as tar:
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
        for key, data in objects.items():
            info = tarfile.TarInfo(key)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return path


def test_extract_everything(spark, archive, objects, tmp_path):
    done = extract_archive(spark, str(archive), f"{tmp_path}/out/", config=SMALL)
    assert below(tmp_path / "out") == digests(objects)
    assert (done.extracted_objects, done.skipped_objects) == (len(objects), 0)
    assert done.extracted_bytes == sum(map(len, objects.values()))


@pytest.mark.parametrize(("filters", "takes"), [(["small", "zero"], lambda k: k in ("small", "zero")), (["long/"], lambda k: k.startswith("long/")), (["**/*.txt", "a*"], lambda k: k.endswith(".txt"))])
def test_extract_with_filters(spark, archive, objects, tmp_path, filters, takes):
    done = extract_archive(spark, str(archive), f"{tmp_path}/pre", filters, SMALL)
    expected = {f"pre{k}": v for k, v in objects.items() if takes(k)}
    assert below(tmp_path) == digests(expected)
    assert done.extracted_objects == len(expected)
    assert done.skipped_objects == len(objects) - len(expected)
    assert done.extracted_bytes + done.skipped_bytes == sum(map(len, objects.values()))


def test_other_types_of_entries(spark, archive, objects):
    assert list_archive(spark, str(archive)).count() == len(objects)
    assert list_archive(spark, str(archive), all_types=True).count() == len(objects) + 1


def test_pax_and_ustar_archives(spark, tmp_path):
    for form in (tarfile.PAX_FORMAT, tarfile.USTAR_FORMAT):
        path = tmp_path / f"{form}.tar"
        names = ["ü" * 70 if form == tarfile.PAX_FORMAT else "u" * 70, "d/" * 60 + "e", "short"]
        with tarfile.open(path, "w", format=form) as tar:
            for n in names:
                info = tarfile.TarInfo(n)
                info.size = 5
                tar.addfile(info, io.BytesIO(b"abcde"))
        assert sorted(r.key for r in list_archive(spark, str(path)).collect()) == sorted(names)


class Counting(io.FileIO):
    """A file that knows how many bytes were read from it."""

    read_bytes = 0

    def read(self, n=-1):
        data = super().read(n)
        type(self).read_bytes += len(data)
        return data


@pytest.mark.parametrize("filters", [["small", "zero"], ["long/", "l/"], ["**/*9*.txt"], ["nothing/"]])
def test_filters_decide_on_headers(archive, objects, monkeypatch, filters):
    """Of entries that no filter takes, nothing but headers is read."""
    monkeypatch.setattr(tar, "open_path", lambda path, store: Counting(path))
    reader = tar._Reader({"path": str(archive), "parts": "true", "filters": json.dumps(filters), "chunkSize": "8KiB", "multipartThreshold": "8KiB"})
    Counting.read_bytes = 0
    spans = reader.partitions()
    walked = Counting.read_bytes
    rows = [r for s in spans for r in reader.read(pickle.loads(pickle.dumps(s)))]
    taken = {k: v for k, v in objects.items() if any(EntryFilter.parse(f).takes(k) for f in filters)}
    assert {k: b"".join(r[5] for r in sorted(rows, key=lambda r: r[2]) if r[0] == k) for k in {r[0] for r in rows}} == taken
    assert Counting.read_bytes <= 2 * walked + sum(map(len, taken.values()))


def test_spans_hold_bounds_only(archive, objects, monkeypatch):
    """A span of entries is two numbers, however many entries it has; tasks walk its headers again."""
    monkeypatch.setattr(tar, "SPAN", 4)
    reader = tar._Reader({"path": str(archive)})
    spans = reader.partitions()
    assert len(spans) > 2
    assert sorted(r[0] for s in spans for r in reader.read(s)) == sorted(objects)


def test_parts_of_an_archive(spark, archive, objects):
    rows = spark.read.format("stowage-tar").options(parts="true", chunkSize="8KiB", multipartThreshold="8KiB").load(str(archive)).orderBy("key", "part_number").collect()
    assert {k: b"".join(bytes(r.data) for r in rows if r.key == k) for k in {r.key for r in rows}} == objects


class Row:
    def __init__(self, key, data, header_offset):
        self.key, self.data, self.size, self.header_offset = key, data, len(data), header_offset
        self.data_offset, self.range_start, self.range_end = header_offset + 512, 0, len(data)


def writer(path):
    return tar._Writer({"path": str(path)})


def test_lost_bytes_fail_the_commit(tmp_path):
    """Bytes that tasks say they wrote, but that the driver's file does not have."""
    one, two = Row("a", b"x" * 600, 0), Row("b", b"y" * 100, 1536)
    w = writer(tmp_path / "a.tar")
    messages = [w.write([one]), w.write([two])]
    w.commit(messages)
    assert contents(tmp_path / "a.tar") == digests({"a": b"x" * 600, "b": b"y" * 100})

    w = writer(tmp_path / "gone.tar")
    messages = [w.write([one]), w.write([two])]
    Path(w.work).unlink()
    with pytest.raises(CorruptArchive):
        w.commit(messages)

    for damage in (lambda f: f.truncate(1536), lambda f: (f.seek(0), f.write(b"\0" * 600)), lambda f: (f.seek(1536), f.write(b"\0" * 1024))):
        w = writer(tmp_path / "lost.tar")
        messages = [w.write([one]), w.write([two])]
        with Path(w.work).open("r+b") as f:
            damage(f)
        with pytest.raises(CorruptArchive):
            w.commit(messages)
    w = writer(tmp_path / "hole.tar")
    with pytest.raises(CorruptArchive):
        w.commit([w.write([two])])
    assert [p.name for p in tmp_path.iterdir()] == ["a.tar"]


def test_messages_do_not_grow_with_rows(tmp_path):
    """Rows that no two tasks have in the archive's order: a run of bytes for each, of which the driver gets no list."""
    objects = {f"k{i}": bytes([i % 251]) * (i % 900) for i in range(3000)}
    rows, at = [], 0
    for k, v in objects.items():
        rows.append(Row(k, v, at))
        at += 512 + -(-len(v) // 512) * 512
    random.Random(1).shuffle(rows)
    w = writer(tmp_path / "a.tar")
    messages = [w.write(rows[i::3]) for i in range(3)]
    assert len(pickle.dumps(messages)) < 3000
    w.commit(messages)
    assert contents(tmp_path / "a.tar") == digests(objects)

    for damage in (lambda f: f.truncate(at - 512), lambda f: (f.seek(rows[7].header_offset), f.write(b"\1"))):
        w = writer(tmp_path / "lost.tar")
        messages = [w.write(rows[i::3]) for i in range(3)]
        with Path(w.work).open("r+b") as f:
            damage(f)
        with pytest.raises(CorruptArchive):
            w.commit(messages)
    w = writer(tmp_path / "hole.tar")
    with pytest.raises(CorruptArchive):
        w.commit([w.write(rows[i::3]) for i in range(2)])
    assert [p.name for p in tmp_path.iterdir()] == ["a.tar"]


def test_a_task_that_does_not_see_the_folder_fails(tmp_path):
    w = writer(tmp_path / "a.tar")
    Path(w.work).unlink()
    with pytest.raises(StowageError, match="folder"):
        w.write([Row("a", b"x", 0)])
    assert not list(tmp_path.iterdir())


def test_plain_paths_are_refused_on_clusters(tmp_path):
    class Cluster:
        class sparkContext:
            master = "spark://there:7077"

    with pytest.raises(StowageError, match="shared_paths"):
        check_path(Cluster, str(tmp_path), Config())
    check_path(Cluster, str(tmp_path), Config(shared_paths=True))
    check_path(Cluster, "s3://bucket/key", Config())


def test_events_of_a_run(spark, store, objects, tmp_path):
    """Tasks log what they did; the log of a successful run holds all invariants, and every kind of event is told."""
    told = {}
    tell = lambda event, **v: told.update({event: v})
    create_archive(spark, [str(store)], f"{tmp_path}/a.tar", SMALL, progress=tell, event_log=f"{tmp_path}/made")
    extract_archive(spark, f"{tmp_path}/a.tar", f"{tmp_path}/out/", ["long/", "large"], SMALL, progress=tell, event_log=f"{tmp_path}/read", verify=True)
    made, read = spark.read.parquet(f"{tmp_path}/made"), spark.read.parquet(f"{tmp_path}/read")
    assert all(r.holds for r in events.reconcile(made.unionByName(read)).collect())
    assert not events.mismatched(made.unionByName(read)).count()
    parts = sum(max(1, -(-len(v) // (8 * KIB))) if len(v) >= 8 * KIB else 1 for v in objects.values())
    assert told["input_part_downloaded"] == {"n": parts, "bytes": sum(map(len, objects.values()))}
    assert told["archive_bytes_written"]["bytes"] == Path(f"{tmp_path}/a.tar").stat().st_size - 1024
    assert told["extract_object_skipped"]["n"] == len(objects) - 4
    stores_only = {"archive_bytes_uploaded", "archive_upload_completed", "extract_archive_part_read"}
    assert set(told) == {*events.CREATE_EVENTS, *events.EXTRACT_EVENTS} - stores_only


def test_verify_finds_changed_bytes(spark, archive, tmp_path, monkeypatch):
    monkeypatch.setattr(api, "_write_in_place", lambda taken, rows, source, store: damaged(api_write(taken, rows, source, store), tmp_path))
    with pytest.raises(StowageError, match="not those of the archive"):
        extract_archive(spark, str(archive), f"{tmp_path}/out/", ["large"], SMALL, verify=True)


api_write = api._write_in_place


def damaged(events_, folder):
    """The events, once their job has run and a byte of what it wrote was changed."""
    done = events_.checkpoint()
    path = folder / "out" / "large"
    data = bytearray(path.read_bytes())
    data[20_000] ^= 1
    path.write_bytes(data)
    return done


def test_damaged_and_missing_archives(spark, archive, tmp_path):
    with pytest.raises(Exception, match="no archive|ArchiveNotFound"):
        list_archive(spark, f"{tmp_path}/none.tar").collect()
    data = bytearray(archive.read_bytes())
    data[600] ^= 1
    broken = tmp_path / "broken.tar"
    broken.write_bytes(data)
    with broken.open("rb") as f, pytest.raises(CorruptArchive):
        list(headers(f))
    assert issubclass(ArchiveNotFound, Exception)


def test_random_entries_round_trip(spark, tmp_path):
    rng = random.Random(11)
    names = {"".join(rng.choices("abcdefghij0123456789", k=rng.randint(1, 200))) for _ in range(100)}
    objects = {n: rng.randbytes(rng.randint(1, 9999)) for n in names}
    put(tmp_path / "in", objects)
    create_archive(spark, [str(tmp_path / "in")], str(tmp_path / "a.tar"), Config(multipart_chunk_size=1000, multipart_threshold=3000))
    assert contents(tmp_path / "a.tar") == digests(objects)
    extract_archive(spark, str(tmp_path / "a.tar"), f"{tmp_path}/out/", config=Config(multipart_chunk_size=777, multipart_threshold=777))
    assert below(tmp_path / "out") == digests(objects)


def test_inputs_as_text():
    assert split_input("s3://bucket/a/b*") == ("s3://bucket", "a/b*")
    assert split_input("s3://bucket") == ("s3://bucket", None)
    assert split_input("/data/x") == ("/data/x", None)
    assert split_input("/data/x//a/*") == ("/data/x", "a/*")


def test_command_line(spark, store, objects, tmp_path, capfdbinary):
    from stowage.cli import main

    assert main(["-q", "create", "-f", f"{tmp_path}/a.tar", str(store)]) == 0
    assert main(["extract", "-f", f"{tmp_path}/a.tar", f"{tmp_path}/out/", "small"]) == 0
    assert below(tmp_path / "out") == digests({"small": objects["small"]})
    assert main(["create", "-f", f"{tmp_path}/b.tar", f"{store}//nothing"]) == 1
    capfdbinary.readouterr()
    assert main(["-q", "create", "-t", str(store)]) == 0
    (tmp_path / "c.tar").write_bytes(capfdbinary.readouterr().out)
    assert contents(tmp_path / "c.tar") == digests(objects)
