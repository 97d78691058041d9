"""Volumes: fixed-size slices of a stream, their manifests and names."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import OffsetError
from ..functions.entries import entry_state, intersects, local_window

log = logging.getLogger(__name__)
DEFAULT_NAME = "{name}_{fingerprint:.8}.tar.{pindex}"


def check_size(size: int) -> None:
    if size <= 0:
        raise ValueError("a volume's size must be positive")


def segments(spark: SparkSession, total: int, size: int) -> DataFrame:
    """vol_index, vol_start, vol_end of the regular grid."""
    check_size(size)
    v = F.col("id")
    return spark.range((total + size - 1) // size).select(v.alias("vol_index"), (v * size).alias("vol_start"), F.least((v + 1) * size, F.lit(total).cast("long")).alias("vol_end"))


def manifest(tracks: DataFrame, total: int, size: int) -> DataFrame:
    """A row for each entry and volume that holds part of it.

    On a regular grid an entry's volumes are a range of indexes, so the interval join is an explode without shuffle.
    """
    check_size(size)
    hit = tracks.withColumn("vol_index", F.explode(F.sequence(F.floor(F.col("start_offset") / size), F.floor((F.col("end_offset") - 1) / size))))
    hit = hit.withColumn("vol_start", F.col("vol_index") * size).withColumn("vol_end", F.least((F.col("vol_index") + 1) * size, F.lit(total).cast("long")))
    return placed(hit)


def placed(hit: DataFrame) -> DataFrame:
    """Rows with vol_start and vol_end -> with state and local window."""
    s, e, lo, hi = (F.col(c) for c in ("start_offset", "end_offset", "vol_start", "vol_end"))
    a, b = local_window(s, e, lo, hi)
    return hit.withColumns({"state": entry_state(s, e, lo, hi), "local_start": a, "local_end": b})


def window_manifest(tracks: DataFrame, start: int, end: int, total: int, index: int = 0) -> DataFrame:
    """The entries of any window."""
    if not 0 <= start < end <= total:
        raise OffsetError(f"window [{start}, {end}) does not lie in the stream of {total} bytes")
    own = tracks.where(intersects(F.col("start_offset"), F.col("end_offset"), F.lit(start), F.lit(end)))
    return placed(own.withColumns({"vol_index": F.lit(index).cast("long"), "vol_start": F.lit(start).cast("long"), "vol_end": F.lit(end).cast("long")}))


def nested(rows: DataFrame) -> DataFrame:
    """One row for each volume with its entries in order, as an array of structs. A volume holds at most one entry for each 512 of its bytes, and two more."""
    window = lambda a, b: F.struct(F.col(a).alias("start"), F.col(b).alias("end"))
    info = F.struct(*(c for c in ("arc_path", "rel_path", "size", "mtime", "mode", "uid", "gid", "uname", "gname", "is_dir", "is_symlink", "linkname", "md5sum") if c in rows.columns))
    entry = F.struct(F.col("start_offset").alias("at"), info.alias("info"), "state", window("start_offset", "end_offset").alias("global_window"), window("local_start", "local_end").alias("local_window"))
    return rows.groupBy("vol_index", "vol_start", "vol_end").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def volume_name(index: Column, total_volumes: int, name: str, fingerprint: str) -> Column:
    """Default names of all volumes, as a Column."""
    width = max(3, len(str(total_volumes)))
    part = (index + 1).cast("string")
    return F.concat(F.lit(f"{name}_{fingerprint[:8]}.tar."), F.lpad(part, F.greatest(F.lit(width), F.char_length(part)), F.lit("0")))


def named(index: int, total_volumes: int, name: str, fingerprint: str, template: str | None = None) -> str:
    """One volume's name by a template of name, fingerprint, index, pindex, part and total; a bad template falls back to the default."""
    known = {"name": name, "fingerprint": fingerprint, "index": index, "part": index + 1, "total": total_volumes, "pindex": f"{index + 1:0{max(3, len(str(total_volumes)))}d}"}
    if template:
        try:
            return template.format(**known)
        except (KeyError, ValueError, IndexError) as e:
            log.warning("volume name template %r: %s; the default is used", template, e)
    return DEFAULT_NAME.format(**known)
