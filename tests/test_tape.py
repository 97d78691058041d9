import hashlib
import io
import os
import tarfile

import pytest

import archivolt
from archivolt import OffsetError, PathReportError, SnapshotError, VolumeStateError


def build(root, files, when=1700000000):
    for rel, data in files.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    for d, _, names in os.walk(root, topdown=False):
        for n in [*names, "."]:
            os.utime(os.path.join(d, n), (when, when), follow_symlinks=False)


@pytest.fixture(scope="module")
def made(tmp_path_factory, spark):
    root = tmp_path_factory.mktemp("t") / "dataset"
    root.mkdir()
    files = {"a_small.txt": "contenido ñ small".encode()[:18], "b_large.bin": bytes(range(250)) * 40, "sub/c_nested.txt": b"nested content here!!", "empty.txt": b""}
    build(root, files)
    os.symlink("a_small.txt", root / "link")
    os.utime(root / "link", (1700000000, 1700000000), follow_symlinks=False)
    os.utime(root, (1700000000, 1700000000))
    return root, files, archivolt.create(root, spark=spark)


def whole(tape, start=0):
    out = io.BytesIO()
    tape.write_stream(out, start)
    return out.getvalue()


@pytest.fixture(scope="module")
def stream(made):
    return whole(made[2])


def test_stream_is_a_tar(made, stream):
    root, files, tape = made
    assert len(stream) == tape.total_size
    with tarfile.open(fileobj=io.BytesIO(stream)) as t:
        assert t.getnames() == sorted(t.getnames()) == ["dataset", "dataset/a_small.txt", "dataset/b_large.bin", "dataset/empty.txt", "dataset/link", "dataset/sub", "dataset/sub/c_nested.txt"]
        for rel, data in files.items():
            assert t.extractfile(f"dataset/{rel}").read() == data
        assert t.getmember("dataset/link").linkname == "a_small.txt" and t.getmember("dataset").mode == 0o755
    assert tape.count_files == 7 and len(tape.fingerprint) == 64


@pytest.mark.parametrize("at", [1, 511, 512, 1536 + 512 + 123, "footer", "last"])
def test_resume_is_the_suffix(made, stream, at):
    tape = made[2]
    at = {"footer": len(stream) - 700, "last": len(stream) - 1}.get(at, at)
    assert whole(tape, at) == stream[at:]


def test_offsets_outside(made):
    tape = made[2]
    with pytest.raises(OffsetError):
        list(tape.play(tape.total_size + 100))
    with pytest.raises(ValueError):
        tape.get_volume("v", 0, 0, tape.total_size + 1)


def test_events(made):
    tape = made[2]
    ev = list(tape.play())
    ends = {e["arc_path"]: e for e in ev if e["type"] == "file_end"}
    assert ends["dataset/b_large.bin"]["md5sum"] == hashlib.md5(bytes(range(250)) * 40).hexdigest()
    assert not ends["dataset/empty.txt"]["is_complete"] and ends["dataset/sub"]["md5sum"] is None
    assert ev[-1]["type"] == "tape_completed" and sum(e["type"] == "file_start" for e in ev) == 7


def test_volumes_join_to_the_stream(made, stream):
    tape = made[2]
    got, names = b"", []
    for volume, manifest in tape.iter_volumes(4096):
        with volume as v:
            data = v.read()
            v.seek(0)
            assert v.read(10) == data[:10] and v.tell() == 10
            assert v.md5sum == hashlib.md5(data).hexdigest()
            with pytest.raises(OffsetError):
                v.seek(v.size + 1)
            with pytest.raises(OffsetError):
                v.seek(-1)
        with pytest.raises(VolumeStateError):
            volume.read(1)
        assert manifest["chunk_size"] == len(data)
        got += data
        names.append(volume.name)
    assert got == stream and names[0] == f"dataset_{tape.fingerprint[:8]}.tar.001"
    digests = {r["vol_index"]: r["md5"] for r in tape.volume_digests(4096).collect()}
    assert digests == {i: hashlib.md5(stream[i * 4096 : (i + 1) * 4096]).hexdigest() for i in range(len(names))}


def test_footer_only_volume(made, stream):
    tape = made[2]
    with tape.get_volume("v", 9, len(stream) - 512, len(stream))[0] as v:
        assert v.read() == bytes(512)


def test_streaming_source_resumes(made, stream, spark, tmp_path):
    from archivolt.sources.content import with_headers
    from archivolt.streaming.tape_stream import read_stream, write_plan

    root, _, tape = made
    plan = write_plan(with_headers(tape.blocks(), tape.tracks), str(tmp_path / "plan"))
    df = read_stream(spark, plan, str(root), start=123, bytes_per_batch=5000)
    q = df.writeStream.format("memory").queryName("bytes_seen").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            if spark.sql("select max(g_end) from bytes_seen").first()[0] == len(stream):
                break
    finally:
        q.stop()
    rows = spark.sql("select g_start, data from bytes_seen order by g_start").collect()
    assert b"".join(bytes(r["data"]) for r in rows) == stream[123:]


def test_verify_and_mutations(tmp_path, spark):
    root = tmp_path / "dataset"
    root.mkdir()
    build(root, {"x.txt": b"one", "sub/y.txt": b"two"})
    tape = archivolt.create(root, spark=spark)
    assert tape.verify(deep=True)
    os.utime(root, (1, 1))
    assert tape.verify(deep=True)
    os.utime(root / "x.txt", (1700000100, 1700000100))
    assert not tape.verify(deep=True)
    with pytest.raises(SnapshotError, match="File modified"):
        tape.verify(deep=True, raise_exception=True)
    (root / "x.txt").write_bytes(b"longer")
    os.utime(root / "x.txt", (1700000000, 1700000000))
    with pytest.raises(SnapshotError, match="File size changed"):
        tape.verify(deep=True, raise_exception=True)
    (root / "x.txt").write_bytes(b"one")
    os.utime(root / "x.txt", (1700000000, 1700000000))
    os.utime(root / "sub", (1700000500, 1700000500))
    with pytest.raises(SnapshotError, match="Directory structure changed"):
        list(tape.play(fast_verify=False))
    (root / "new.txt").write_bytes(b"")
    with pytest.raises(SnapshotError, match="untracked"):
        tape.verify(raise_exception=True)
    tape.destroy()
    assert not archivolt.exists(root) and archivolt.get_tape(root) is None


def test_create_rules(tmp_path, spark):
    root = tmp_path / "dataset"
    root.mkdir()
    build(root, {"keep.txt": b"1", "ignore.log": b"2", "deep/__pycache__/z.pyc": b"3"})
    tape = archivolt.create(root, exclude="*.log", spark=spark)
    assert [r["rel_path"] for r in tape.get_tracks().collect()] == ["", "deep", "deep/__pycache__", "deep/__pycache__/z.pyc", "keep.txt"]
    assert tape.verify(deep=True)
    with pytest.raises(FileExistsError):
        archivolt.create(root, spark=spark)
    tape = archivolt.create(root, overwrite=True, calculate_hashes=True, spark=spark, cache_dir=tmp_path / "cache")
    rows = {r["rel_path"]: r["md5sum"] for r in tape.get_tracks().collect()}
    assert "deep/__pycache__" not in rows and rows["keep.txt"] == hashlib.md5(b"1").hexdigest() and rows["deep"] is None
    tape = archivolt.create(root, exclude=lambda p: p.name.startswith("k"), overwrite=True, calculate_hashes=True, spark=spark, cache_dir=tmp_path / "cache")
    assert "keep.txt" not in {r["rel_path"] for r in tape.get_tracks().collect()}
    with pytest.raises(ValueError):
        archivolt.create(root / "keep.txt", spark=spark)
    with pytest.raises(NotADirectoryError):
        archivolt.discover(root / "none")
    build(root, {"f/" + "a" * 101: b""})
    with pytest.raises(PathReportError, match="component too long"):
        archivolt.create(root, overwrite=True, spark=spark)
    tape = archivolt.create(root, overwrite=True, auto_truncate=True, spark=spark)
    assert max(len(r["arc_path"]) for r in tape.get_tracks().collect()) == len("dataset/f/") + 100


def test_scan_prunes_and_survives_unreadable_folders(tmp_path, spark, monkeypatch):
    from archivolt.sources import filesystem

    root = tmp_path / "dataset"
    root.mkdir()
    build(root, {f"d{i}/e{j}/f.txt": b"x" for i in range(9) for j in range(9)} | {"node_modules/a/b.js": b"y", "d0/__pycache__/m.pyc": b"z"})
    reader = filesystem._Reader(str(root), (".archivolt",), ["node_modules", "__pycache__"])
    entered = []
    real = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: entered.append(str(p)) or real(p))
    parts = reader.partitions()
    rows = [r[0] for p in parts for r in reader.read(p)]
    assert sum(p.deep for p in parts) == 81 and len(rows) == len(set(rows)) == 1 + 9 + 81 + 81
    assert not any("node_modules" in p or "__pycache__" in p for p in entered)

    def closed(p):
        if str(p).endswith("d3"):
            raise PermissionError(p)
        return real(p)

    monkeypatch.setattr(os, "scandir", closed)
    rows = [r[0] for r in filesystem.walk(str(root), "", True, reader._rule())]
    assert "d3" in rows and "d3/e0" not in rows and "d4/e0/f.txt" in rows


def test_a_failed_overwrite_keeps_the_record(tmp_path, spark):
    root = tmp_path / "dataset"
    root.mkdir()
    build(root, {"x.txt": b"one"})
    before = archivolt.create(root, spark=spark).fingerprint
    (root / ("n" * 101)).write_bytes(b"")
    with pytest.raises(archivolt.PathLimitError):
        archivolt.create(root, spark=spark, overwrite=True)
    assert archivolt.get_tape(root, spark).fingerprint == before
    os.remove(root / ("n" * 101))
    (root / "y.txt").write_bytes(b"two")
    assert archivolt.create(root, spark=spark, overwrite=True).count_files == 3 and sorted(p.name for p in root.iterdir()) == [".archivolt", "x.txt", "y.txt"]


def test_volume_digest_reads_only_what_was_not_read(made, monkeypatch):
    tape = made[2]
    volume, manifest = next(iter(tape.iter_volumes(4096)))
    assert isinstance(volume, archivolt.TapeVolume) and set(manifest) == {"tape_fingerprint", "volume_index", "start_offset", "end_offset", "chunk_size", "entries"}
    assert set(manifest["entries"][0]) == {"at", "info", "state", "global_window", "local_window"}
    with volume as v:
        first = v.read(1000)
        v.seek(3000)
        v.read(10)
        asked = []
        real = tape._rows
        monkeypatch.setattr(tape, "_rows", lambda a, b=None: asked.append(a) or real(a, b))
        v.seek(0)
        whole = v.read()
        assert whole[:1000] == first and v.md5sum == hashlib.md5(whole).hexdigest() and asked == [0]
        with pytest.raises(ValueError):
            v.seek(0, 9)


def test_changed_files_are_not_emitted(tmp_path):
    from archivolt.sources.content import read_range

    f = tmp_path / "f"
    f.write_bytes(b"12345")
    os.utime(f, (100, 100))
    assert read_range(str(tmp_path), "f", 1, 3, 5, 100, "f") == b"234"
    for size, mtime, said in ((6, 100, "size changed"), (5, 101, "modified")):
        with pytest.raises(SnapshotError, match=said):
            read_range(str(tmp_path), "f", 0, 5, size, mtime, "f")
    with pytest.raises(SnapshotError, match="missing"):
        read_range(str(tmp_path), "g", 0, 5, 5, 100, "g")


def test_hash_cache_keeps_digests_of_a_broken_run(tmp_path, spark, monkeypatch):
    from archivolt import tape as facade

    root, cache = tmp_path / "dataset", tmp_path / "cache"
    root.mkdir()
    files = {f"f{i}": bytes([i]) * 100 for i in range(20)}
    build(root, files)
    monkeypatch.setattr(facade, "CACHE_FLUSH_BYTES", 400)
    real, calls = facade.content.content_digests, []

    def breaks(inv, where):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(inv, where)

    monkeypatch.setattr(facade.content, "content_digests", breaks)
    with pytest.raises(RuntimeError):
        archivolt.create(root, spark=spark, calculate_hashes=True, cache_dir=cache)
    kept = spark.read.parquet(str(next(cache.glob("*.db")))).count()
    assert 0 < kept < 20
    tape = archivolt.create(root, spark=spark, calculate_hashes=True, cache_dir=cache)
    got = {r["rel_path"]: r["md5sum"] for r in tape.tracks.where("not is_dir").collect()}
    assert got == {n: hashlib.md5(b).hexdigest() for n, b in files.items()} and len(list(cache.iterdir())) == 1
