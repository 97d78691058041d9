"""The facade: record a folder, then ask, verify, play, slice."""

from __future__ import annotations

import hashlib
import io
import json
import os
import shutil
import time
import uuid
from abc import abstractmethod
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import CACHE_FLUSH_BYTES, DEFAULT_EXCLUDES, META_DIR, PIECE, SAMPLE_ROWS
from .errors import ArchiveNotFoundError, OffsetError, SnapshotError, VerificationError, VolumeStateError
from .operators import hash_cache, integrity
from .functions.paths import as_patterns
from .operators.inventory import decode_excludes, encode_excludes, inventory, raise_violations
from .plans import blocks as blk
from .plans import layout as lay
from .plans import volumes as vol
from .sources import content, filesystem


def _spark(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.builder.getOrCreate()


def discover(directory) -> Path | None:
    """The folder of a recorded archive's tables, or None."""
    d = Path(directory)
    if not d.is_dir():
        raise NotADirectoryError(str(d))
    meta = d / META_DIR
    return meta if (meta / "tracks").is_dir() else None


def exists(directory) -> bool:
    return discover(directory) is not None


def get_tape(directory, spark: SparkSession | None = None) -> Tape | None:
    return Tape(directory, spark) if exists(directory) else None


def get_catalog(directory, spark: SparkSession | None = None) -> DataFrame:
    """The tracks table."""
    if not exists(directory):
        raise ArchiveNotFoundError(f"no recorded archive in {directory}")
    return Tape(directory, spark).tracks


def cache_folder() -> Path:
    return Path(os.environ.get("LOCALAPPDATA") or Path.home() / ".cache") / "archivolt" / "hashes"


#: Most times that new digests are written out while a folder is hashed.
MOST_FLUSHES = 100


def _digests(spark: SparkSession, inv: DataFrame, root: Path, folder: Path) -> DataFrame:
    """inventory with content digests, from the folder's cache where it has them.

    New digests are appended to the cache by parts of about CACHE_FLUSH_BYTES of content, so what a crash leaves is not lost. At the end the cache is written
    anew without double keys and moved into place; the oldest caches beyond the limits are dropped.
    """
    folder.mkdir(parents=True, exist_ok=True)
    listing = [(p.name, p.stat().st_mtime, sum(f.stat().st_size for f in p.rglob("*") if f.is_file())) for p in folder.glob("*.db")]
    if listing:
        for row in hash_cache.evictions(spark.createDataFrame(listing, "name string, mtime double, size long")).collect():  # one folder's listing
            shutil.rmtree(folder / row["name"], ignore_errors=True)
    own = folder / f"cache_{hashlib.sha1(str(root).encode()).hexdigest()}.db"
    key = "arc_path string, size long, mtime long, md5sum string"

    def cached() -> DataFrame:
        return spark.read.schema(key).parquet(str(own)) if own.exists() else spark.createDataFrame([], key)

    wanted = hash_cache.probe(inv, cached()).where("not hit and not is_dir and not is_symlink")
    weight = wanted.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    flushes = min(MOST_FLUSHES, max(1, -(-weight // CACHE_FLUSH_BYTES)))
    part = F.pmod(F.xxhash64("arc_path"), F.lit(flushes))
    # the parts are looked up against the cache as it was: what they append must not be read while it is written
    pending = folder / f"{own.name}.{uuid.uuid4().hex}"
    try:
        wanted.drop("hit").select("arc_path", "rel_path", "size", "mtime", "is_dir", "is_symlink", part.alias("part")).write.parquet(str(pending))
        for i in range(flushes):
            content.content_digests(spark.read.parquet(str(pending)).where(F.col("part") == i), str(root)).write.mode("append").parquet(str(own))
    finally:
        shutil.rmtree(pending, ignore_errors=True)
    new, old = (folder / f"{own.name}.{uuid.uuid4().hex}" for _ in range(2))
    cached().dropDuplicates(list(hash_cache.KEY)).write.parquet(str(new))
    own.rename(old)
    new.rename(own)
    shutil.rmtree(old)
    return hash_cache.probe(inv, cached()).drop("hit").select(*inv.columns)


def create(directory, exclude=None, anonymize: bool = True, calculate_hashes: bool = False, overwrite: bool = False, auto_truncate: bool = False, spark: SparkSession | None = None, cache_dir=None) -> Tape:
    """Record a folder. Its tables are written beside and moved into place, so a half-written record is never seen; an old record goes only then."""
    root = Path(directory).resolve()
    if not root.is_dir():
        raise ValueError(f"{root} is not a directory")
    meta = root / META_DIR
    if (meta / "tracks").exists() and not overwrite:
        raise FileExistsError(f"{root} is already recorded")
    spark = _spark(spark)
    rules = DEFAULT_EXCLUDES if exclude is None else exclude
    found = filesystem.scan(spark, str(root), (META_DIR,), () if callable(rules) else as_patterns(rules))
    inv = inventory(found, root.name, rules, anonymize, auto_truncate)
    raise_violations(inv)
    if calculate_hashes:
        inv = _digests(spark, inv, root, Path(cache_dir) if cache_dir else cache_folder())
    part, old = (root / f"{META_DIR}.{uuid.uuid4().hex}" for _ in range(2))
    try:
        lay.layout(inv).orderBy("start_offset").write.parquet(str(part / "tracks"))  # by offset, so range filters skip row groups
        lay.stats(spark.read.parquet(str(part / "tracks")), int(time.time()), encode_excludes(rules)).write.parquet(str(part / "stats"))
        if meta.exists():
            meta.rename(old)
        part.rename(meta)
    finally:
        for left in (part, old):
            if left.exists():
                shutil.rmtree(left)
    return Tape(root, spark)


class Tape:
    """A recorded folder."""

    def __init__(self, directory, spark: SparkSession | None = None):
        self.directory = Path(directory).resolve()
        if not (self.directory / META_DIR / "tracks").is_dir():
            raise ArchiveNotFoundError(f"no recorded archive in {directory}")
        self.spark = _spark(spark)
        self.tracks = self.spark.read.parquet(str(self.directory / META_DIR / "tracks"))
        self.stats = lay.stats_map(self.spark.read.parquet(str(self.directory / META_DIR / "stats")).first().asDict())

    fingerprint = property(lambda self: self.stats["fingerprint"])
    total_size = property(lambda self: self.stats["total_size"])
    created_at = property(lambda self: self.stats["created_at"])
    count_files = property(lambda self: self.stats["track_count"])

    @property
    def exclude_patterns(self):
        return decode_excludes(self.stats["exclude_patterns"])

    def get_tracks(self) -> DataFrame:
        return self.tracks.orderBy("arc_path")

    def destroy(self) -> None:
        shutil.rmtree(self.directory / META_DIR)

    def verify(self, deep: bool = False, raise_exception: bool = False) -> bool:
        """Whether the folder still is what was recorded: the root's items, then all entries or a random sample."""
        try:
            rules = self.exclude_patterns
            present = self.spark.createDataFrame([r for r in filesystem.walk(str(self.directory), "", False) if r[9] or r[10] or r[11]], filesystem.SNAPSHOT)
            if not (isinstance(rules, str) and rules.startswith("<dynamic")):
                row = integrity.root_difference(self.tracks, present, [rules] if isinstance(rules, str) else rules).first()
                if row["untracked"]:
                    raise SnapshotError(f"{row['untracked']} untracked item(s) in the root folder")
            some = self.tracks
            if not deep:
                picked = [r["arc_path"] for r in integrity.sample(self.tracks, SAMPLE_ROWS).select("arc_path").collect()]  # SAMPLE_ROWS rows
                some = self.tracks.where(F.col("arc_path").isin(picked))
            bad = integrity.first_violation(some, filesystem.probe(some, str(self.directory))).collect()
            if bad:
                raise SnapshotError(f"{bad[0]['violation']}: {bad[0]['arc_path']}")
            return True
        except SnapshotError:
            if raise_exception:
                raise
            return False
        except Exception as e:
            if raise_exception:
                raise VerificationError(str(e)) from e
            return False

    def check_resume(self, offset: int) -> None:
        """A resume offset must lie in the stream, and the entry it falls in must be unchanged; the footer has none."""
        lay.check_offset(offset, self.total_size)
        at = lay.track_at(self.tracks, offset)
        bad = integrity.violations(at, filesystem.probe(at, str(self.directory))).collect()  # one entry
        if bad:
            raise SnapshotError(f"{bad[0]['violation']}: {bad[0]['arc_path']}")

    def blocks(self, start: int = 0, end: int | None = None, piece: int = PIECE) -> DataFrame:
        return blk.clip(blk.block_plan(self.tracks, piece), start, end)

    def block_data(self, start: int = 0, end: int | None = None, piece: int = PIECE) -> DataFrame:
        return content.folder_bytes(self.blocks(start, end, piece), self.tracks, str(self.directory)).orderBy("g_start")

    def play(self, start_offset: int = 0, chunk_size: int = 1 << 16, fast_verify: bool = True) -> Iterator[dict]:
        """Events in stream order, data in pieces of at most chunk_size. Nothing runs before the first event is asked for."""
        self.verify(deep=not fast_verify, raise_exception=True)
        if start_offset > 0:
            self.check_resume(start_offset)
        start = max(0, start_offset)
        marks = blk.events(self.tracks, start).orderBy("at", "rank").toLocalIterator()
        mark, digest = next(marks), None
        for row in self._rows(start):
            while mark["type"] == "file_end" and mark["end_offset"] <= row["g_start"] or mark["type"] == "file_start" and row["arc_path"] == mark["arc_path"]:
                if mark["type"] == "file_start":
                    digest = hashlib.md5()
                    yield {"type": "file_start", "arc_path": mark["arc_path"], "start_offset": mark["start_offset"], "resumed": mark["resumed"]}
                else:
                    yield self._end(mark, digest)
                mark = next(marks)
            if row["kind"] == "body":
                digest.update(row["data"])
            for i in range(0, len(row["data"]), chunk_size):
                yield {"type": "file_data", "arc_path": row["arc_path"], "data": bytes(row["data"][i : i + chunk_size])}
        while mark["type"] != "tape_completed":
            yield self._end(mark, digest)
            mark = next(marks)
        yield {"type": "tape_completed"}

    @staticmethod
    def _end(mark, digest) -> dict:
        return {"type": "file_end", "arc_path": mark["arc_path"], "end_offset": mark["end_offset"], "md5sum": digest.hexdigest() if mark["is_complete"] and digest else None, "is_complete": mark["is_complete"]}

    def _rows(self, start: int, end: int | None = None):
        try:
            yield from self.block_data(start, end).toLocalIterator()
        except Exception as e:
            for line in str(e).splitlines():
                if "SnapshotError: " in line:
                    raise SnapshotError(line.split("SnapshotError: ", 1)[1]) from e
            raise

    def write_stream(self, out, start_offset: int = 0) -> int:
        """Write the stream's bytes to a file object; returns their number."""
        n = 0
        for e in self.play(start_offset):
            if e["type"] == "file_data":
                out.write(e["data"])
                n += len(e["data"])
        return n

    def manifest(self, size: int) -> DataFrame:
        return vol.manifest(self.tracks, self.total_size, size)

    def volume_digests(self, size: int) -> DataFrame:
        """vol_index, n_bytes, md5 of all volumes, each in one task of its own."""
        return content.folder_digests(blk.by_volume(blk.block_plan(self.tracks, min(PIECE, size)), size), self.tracks, str(self.directory), "vol_index")

    def iter_volumes(self, size: int, naming_template: str | None = None) -> Iterator[tuple[Volume, dict]]:
        """All volumes in order. One job computes the manifests, which come to the driver one volume at a time."""
        vol.check_size(size)
        n = (self.total_size + size - 1) // size
        rows = vol.nested(self.manifest(size)).orderBy("vol_index").toLocalIterator()
        row = next(rows, None)
        for i in range(n):
            own = row is not None and row["vol_index"] == i
            yield self._volume(i, i * size, min((i + 1) * size, self.total_size), vol.named(i, n, self.directory.name, self.fingerprint, naming_template), row["entries"] if own else [])
            row = next(rows, None) if own else row

    def get_volume(self, name: str, index: int, start: int, end: int) -> tuple[Volume, dict]:
        """Any window as a volume."""
        rows = vol.nested(vol.window_manifest(self.tracks, start, end, self.total_size, index)).collect()  # one volume's manifest
        return self._volume(index, start, end, name, rows[0]["entries"] if rows else [])

    def _volume(self, index: int, start: int, end: int, name: str, entries: list) -> tuple[Volume, dict]:
        made = {"tape_fingerprint": self.fingerprint, "volume_index": index, "start_offset": start, "end_offset": end, "chunk_size": end - start, "entries": [e.asDict(True) for e in entries]}
        return Volume(self, name, start, end), made


class TapeVolume(io.RawIOBase):
    """What every kind of volume has, whatever its bytes come from: a name, a size, reading, seeking, and a digest of the whole."""

    name: str
    size: int

    @property
    @abstractmethod
    def is_completed(self) -> bool:
        """Whether reading stands at the end."""

    @property
    @abstractmethod
    def md5sum(self) -> str:
        """Digest of the whole volume."""

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True


class Volume(TapeVolume):
    """A slice of the stream as a read-only, seekable file. It opens with `with`."""

    def __init__(self, tape: Tape, name: str, start: int, end: int):
        self.tape, self.name, self.start_offset, self.end_offset, self.size = tape, name, start, end, end - start
        self._open, self._at, self._rows, self._held = False, 0, None, b""
        #: A digest of the volume's first bytes, as far as reading went without a gap.
        self._digest, self._digested = hashlib.md5(), 0

    def __enter__(self):
        self._open, self._at, self._rows, self._held = True, 0, None, b""
        return self

    def __exit__(self, *exc):
        self._open, self._rows = False, None

    def _check(self):
        if not self._open:
            raise VolumeStateError("I/O operation on closed volume")

    def tell(self):
        self._check()
        return self._at

    def seek(self, offset, whence=io.SEEK_SET):
        self._check()
        if whence not in (io.SEEK_SET, io.SEEK_CUR, io.SEEK_END):
            raise ValueError(f"bad whence {whence}")
        to = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self._at, io.SEEK_END: self.size}[whence]
        if not 0 <= to <= self.size:
            raise OffsetError(f"position {to} is outside a volume of {self.size} bytes")
        if to != self._at:
            self._at, self._rows, self._held = to, None, b""
        return to

    def read(self, size=-1):
        self._check()
        want = self.size - self._at if size is None or size < 0 else min(size, self.size - self._at)
        out = bytearray()
        while len(out) < want:
            if not self._held:
                if self._rows is None:
                    self._rows = self.tape._rows(self.start_offset + self._at + len(out), self.end_offset)
                self._held = bytes(next(self._rows)["data"])
            take = self._held[: want - len(out)]
            out += take
            self._held = self._held[len(take) :]
        self._note(self._at, out)
        self._at += len(out)
        return bytes(out)

    def _note(self, at: int, data: bytes) -> None:
        if at <= self._digested < at + len(data):
            self._digest.update(memoryview(data)[self._digested - at :])
            self._digested = at + len(data)

    @property
    def is_completed(self) -> bool:
        return self._at == self.size

    @property
    def md5sum(self) -> str:
        """Of the whole volume, wherever reading stands: what was read in order is not read again."""
        if self._digested < self.size:
            for row in self.tape._rows(self.start_offset + self._digested, self.end_offset):
                self._note(row["g_start"] - self.start_offset, row["data"])
        return self._digest.hexdigest()
