"""Scalar expressions of an entry: kind, padding, block size, offsets, identity, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BLOCK


def has_content(is_dir: Column, is_symlink: Column) -> Column:
    return ~is_dir & ~is_symlink


def entry_kind(is_dir: Column, is_symlink: Column) -> Column:
    return F.when(is_dir, "dir").when(is_symlink, "symlink").otherwise("file")


def effective_size(size: Column, is_dir: Column, is_symlink: Column) -> Column:
    return F.when(has_content(is_dir, is_symlink), size).otherwise(F.lit(0)).cast("long")


def padding_size(size: Column, content: Column) -> Column:
    return F.when(content & (size > 0), F.pmod(BLOCK - size % BLOCK, F.lit(BLOCK))).otherwise(F.lit(0)).cast("long")


def block_size(size: Column, content: Column) -> Column:
    return (F.lit(BLOCK) + F.when(content, size).otherwise(F.lit(0)) + padding_size(size, content)).cast("long")


def header_end(start: Column) -> Column:
    return start + BLOCK


def content_end(start: Column, size: Column, content: Column) -> Column:
    return header_end(start) + F.when(content, size).otherwise(F.lit(0))


def contains(start: Column, end: Column, offset) -> Column:
    """offset lies in [start, end)."""
    return (start <= offset) & (end > offset)


def intersects(start: Column, end: Column, lo, hi) -> Column:
    """[start, end) and [lo, hi) overlap."""
    return (start < hi) & (end > lo)


def normalized_mode(mode: Column, is_dir: Column, is_symlink: Column) -> Column:
    """Permissions without what differs between systems: any execute bit makes a file 0755, else 0644."""
    run = mode.bitwiseAND(F.lit(0o111)) != 0
    return F.when(is_dir, 0o755).when(is_symlink, 0o777).when(run, 0o755).otherwise(0o644).cast("int")


def entry_state(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """How [start, end) lies in the view [lo, hi), by global offsets."""
    opens, closes = start >= lo, end <= hi
    return F.when(opens & closes, "complete").when(opens, "head").when(closes, "tail").otherwise("body")


def local_window(start: Column, end: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    zero = F.lit(0).cast("long")
    return F.greatest(zero, F.greatest(start, lo) - lo), F.greatest(zero, F.least(end, hi) - lo)


def identity_text(arc_path: Column, size: Column, mtime: Column) -> Column:
    """What an entry adds to the fingerprint."""
    return F.concat_ws("|", arc_path, size.cast("string"), mtime.cast("string"))


def cache_name(root: Column) -> Column:
    return F.concat(F.lit("cache_"), F.sha1(root), F.lit(".db"))


def absolute_path(root: str, rel_path: Column) -> Column:
    return F.when(rel_path == "", F.lit(root)).otherwise(F.concat_ws("/", F.lit(root), rel_path))
