"""Comparing a recorded snapshot (T0) with the present one (T1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import META_DIR, SAMPLE_ROWS
from ..functions.paths import excluded


def violations(tracks: DataFrame, now: DataFrame) -> DataFrame:
    """arc_path, violation: the first rule that each recorded entry breaks, in this order: missing, folder changed, file modified, size changed.

    now: rel_path, exists, mtime, size. The root's time is not compared, nor are modes, owners, link targets or contents.
    """
    t1 = now.select(F.col("rel_path"), F.col("exists").alias("_there"), F.col("mtime").alias("_mtime"), F.col("size").alias("_size"))
    root = F.col("rel_path").isin("", ".")
    moved = F.col("_mtime") != F.col("mtime")
    why = (
        F.when(~F.coalesce("_there", F.lit(False)), "File missing")
        .when(F.col("is_dir"), F.when(~root & moved, "Directory structure changed"))
        .when(moved, "File modified (mtime)")
        .when(~F.col("is_symlink") & (F.col("_size") != F.col("size")), "File size changed")
    )
    return tracks.join(t1, "rel_path", "left").select("arc_path", why.alias("violation")).where("violation is not null")


def first_violation(tracks: DataFrame, now: DataFrame) -> DataFrame:
    """The violation that a pass in path order meets first."""
    return violations(tracks, now).orderBy("arc_path").limit(1)


def sample(tracks: DataFrame, rows: int = SAMPLE_ROWS, seed: int | None = None) -> DataFrame:
    """Some random tracks; with a seed by a hash of the path, the same each time."""
    order = F.rand() if seed is None else F.md5(F.concat(F.lit(str(seed)), F.col("arc_path")))
    return tracks.orderBy(order).limit(rows)


def at_root(rel_path):
    return (rel_path != "") & (F.instr(rel_path, "/") == 0)


def root_difference(tracks: DataFrame, now: DataFrame, exclude=()) -> DataFrame:
    """One row: recorded and present items of the root folder (excluded ones and the metadata left out), and how many more there are now."""
    patterns = [] if callable(exclude) else list(exclude)
    rel = F.col("rel_path")
    old = tracks.where(at_root(rel)).agg(F.count("*").alias("recorded"))
    new = now.where(at_root(rel) & (rel != META_DIR) & ~excluded(rel, patterns)).agg(F.count("*").alias("present"))
    return old.join(F.broadcast(new)).select("recorded", "present", F.greatest(F.col("present") - F.col("recorded"), F.lit(0)).alias("untracked"))


def untracked(tracks: DataFrame, now: DataFrame) -> DataFrame:
    """Present paths that were never recorded: the full difference, which balanced additions and removals can't hide from."""
    return now.select("rel_path").join(tracks.select("rel_path"), "rel_path", "left_anti")
