"""Bytes of block plans: headers from columns, contents by ranged reads in tasks, NULs for padding and footer."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import READ_BYTES
from ..errors import SnapshotError
from ..functions.header import entry_columns, header_hex
from ..plans.blocks import zero_bytes

DATA = "arc_path string, kind string, g_start long, g_end long, data binary"


def with_headers(blocks: DataFrame, tracks: DataFrame) -> DataFrame:
    """Blocks with what a reader needs of their entries: header (hex; null but for headers), size and mtime as recorded."""
    heads = tracks.select("arc_path", header_hex(entry_columns()).alias("header"), F.col("size").alias("t_size"), F.col("mtime").alias("t_mtime"))
    kinds = blocks.join(heads, "arc_path", "left")
    return kinds.withColumn("header", F.when(F.col("kind") == "header", F.col("header")))


def read_range(root: str, rel: str, offset: int, size: int, t_size: int, t_mtime: int, arc: str) -> bytes:
    """A checked ranged read: the file must be what was recorded, before and after."""
    path = os.path.join(root, rel)
    try:
        st = os.lstat(path)
        if int(st.st_mtime) != t_mtime:
            raise SnapshotError(f"File modified (mtime): {arc}")
        if st.st_size != t_size:
            raise SnapshotError(f"File size changed: {arc}")
        out = bytearray()
        with open(path, "rb") as f:
            f.seek(offset)
            while len(out) < size:
                part = f.read(min(READ_BYTES, size - len(out)))
                if not part:
                    raise SnapshotError(f"File shrunk while it was read: {arc}")
                out += part
            if offset + size == t_size and f.read(1):
                raise SnapshotError(f"File grew while it was read: {arc}")
        return bytes(out)
    except FileNotFoundError as e:
        raise SnapshotError(f"File missing: {arc}") from e
    except OSError as e:
        raise SnapshotError(f"File can't be read: {arc}: {e}") from e


_NEEDED = ("arc_path", "rel_path", "kind", "g_start", "g_end", "src_offset", "skip", "header", "t_size", "t_mtime")


def block_bytes(root: str, arc: str, rel: str, kind: str, a: int, b: int, off: int, skip: int, header: str, size: int, mtime: int) -> bytes:
    """The bytes of one clipped block."""
    if kind == "header":
        return bytes.fromhex(header)[skip : skip + b - a]
    return read_range(root, rel, off, b - a, size, mtime, arc) if kind == "body" else bytes(b - a)


def folder_bytes(blocks: DataFrame, tracks: DataFrame, root: str) -> DataFrame:
    """Clipped blocks -> with data, contents read from a folder that all executors see. A block is at most one piece long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                arc, _, kind, a, b = row[:5]
                yield pa.RecordBatch.from_arrays([pa.array([arc], pa.string()), pa.array([kind]), pa.array([a]), pa.array([b]), pa.array([block_bytes(root, *row)], pa.binary())], names=["arc_path", "kind", "g_start", "g_end", "data"])

    return with_headers(blocks, tracks).select(*_NEEDED).mapInArrow(run, DATA)


def folder_digests(blocks: DataFrame, tracks: DataFrame, root: str, key: str) -> DataFrame:
    """Clipped blocks with a key -> key, n_bytes, md5 over each key's bytes in order, read from a folder that all executors see.

    Only rows of the plan are shuffled: the task that gets a key's blocks, sorted, reads and digests them piece by piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, n = None, None, 0
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h is None or k != now:
                    if h is not None:
                        yield _digest_row(key, now, n, h)
                    now, h, n = k, hashlib.md5(), 0
                data = block_bytes(root, *row)
                h.update(data)
                n += len(data)
        if h is not None:
            yield _digest_row(key, now, n, h)

    rows = with_headers(blocks, tracks).select(F.col(key).cast("long").alias(key), *_NEEDED)
    return rows.repartition(key).sortWithinPartitions(key, "g_start").mapInArrow(run, f"{key} long, n_bytes long, md5 string")


def _digest_row(key: str, value: int, n: int, h) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([value], pa.int64()), pa.array([n], pa.int64()), pa.array([h.hexdigest()])], names=[key, "n_bytes", "md5"])


def column_bytes(blocks: DataFrame, tracks: DataFrame, contents: DataFrame, content: str = "content") -> DataFrame:
    """The same with contents from a column (arc_path, content binary): no Python."""
    rows = with_headers(blocks, tracks).join(contents.select("arc_path", F.col(content).alias("_c")), "arc_path", "left")
    n = (F.col("g_end") - F.col("g_start")).cast("int")
    data = F.when(F.col("kind") == "header", F.substring(F.unhex("header"), (F.col("skip") + 1).cast("int"), n)).when(F.col("kind") == "body", F.substring(F.col("_c"), (F.col("src_offset") + 1).cast("int"), n)).otherwise(zero_bytes(n))
    return rows.select(*(c for c in blocks.columns if c not in ("rel_path", "src_offset", "skip")), data.alias("data"))


def ordered_digest(data: DataFrame, key: str) -> DataFrame:
    """(key, g_start, data) -> key, n_bytes, md5 over each key's bytes in order.

    Rows are dealt by key and sorted; a task feeds one digest piece by piece, so a volume may be larger than memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, n = None, None, 0
        for batch in batches:
            for k, d in zip(batch.column(0), batch.column(1), strict=True):
                k = k.as_py()
                if h is None or k != now:
                    if h is not None:
                        yield _digest_row(key, now, n, h)
                    now, h, n = k, hashlib.md5(), 0
                h.update(d.as_buffer())
                n += len(d.as_buffer())
        if h is not None:
            yield _digest_row(key, now, n, h)

    rows = data.select(F.col(key).cast("long").alias(key), "g_start", "data").repartition(key).sortWithinPartitions(key, "g_start").select(key, "data")
    return rows.mapInArrow(run, f"{key} long, n_bytes long, md5 string")


def file_md5(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "md5").hexdigest()


def content_digests(inv: DataFrame, root: str) -> DataFrame:
    """arc_path, size, mtime, md5sum of the inventory's regular files, read in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arc, rel, size, mtime = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(arc, pa.string()), pa.array(size, pa.int64()), pa.array(mtime, pa.int64()), pa.array([file_md5(os.path.join(root, r)) for r in rel], pa.string())], names=["arc_path", "size", "mtime", "md5sum"])

    return inv.where("not is_dir and not is_symlink").select("arc_path", "rel_path", "size", "mtime").mapInArrow(run, "arc_path string, size long, mtime long, md5sum string")
