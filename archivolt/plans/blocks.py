"""Block plans: what the stream emits, byte range by byte range, before any content is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BLOCK, FOOTER, PIECE
from ..functions.entries import content_end, has_content, header_end


def block_plan(tracks: DataFrame, piece: int = PIECE) -> DataFrame:
    """tracks -> arc_path, rel_path, kind, g_start, g_end, src_offset (where in the entry's content a body piece begins).

    Bodies are cut into pieces of bounded size. The footer comes from all tracks, so it is placed right even where a resume skips them all.
    """
    s, size = F.col("start_offset"), F.col("size")
    content = has_content(F.col("is_dir"), F.col("is_symlink"))
    top, end = header_end(s), content_end(s, size, content)
    part = lambda kind, a, b, off: F.struct(F.lit(kind).alias("kind"), a.alias("g_start"), b.alias("g_end"), off.cast("long").alias("src_offset"))
    zero = F.lit(0)
    pieces = F.transform(F.when(end > top, F.sequence(F.lit(0).cast("long"), end - top - 1, F.lit(piece).cast("long"))).otherwise(F.array().cast("array<bigint>")), lambda o: part("body", top + o, F.least(top + o + piece, end), o))
    both = F.concat(F.array(part("header", s, top, zero)), pieces, F.array(part("padding", end, F.col("end_offset"), zero)))
    rows = tracks.select("arc_path", "rel_path", F.explode(F.filter(both, lambda x: x["g_end"] > x["g_start"])).alias("b")).select("arc_path", "rel_path", "b.*")
    last = tracks.agg(F.coalesce(F.max("end_offset"), F.lit(0)).cast("long").alias("z"))
    none = F.lit(None).cast("string")
    footer = last.select(none.alias("arc_path"), none.alias("rel_path"), F.lit("footer").alias("kind"), F.col("z").alias("g_start"), (F.col("z") + FOOTER).alias("g_end"), F.lit(0).cast("long").alias("src_offset"))
    return rows.union(footer)


def clip(blocks: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Blocks of [start, end) cut to it: skip is what is left out of a block's head. src_offset moves with it in bodies."""
    rows = blocks.where(F.col("g_end") > start)
    stop = F.col("g_end")
    if end is not None:
        rows, stop = rows.where(F.col("g_start") < end), F.least("g_end", F.lit(end).cast("long"))
    first = F.greatest("g_start", F.lit(start).cast("long"))
    skip = first - F.col("g_start")
    return rows.select("arc_path", "rel_path", "kind", first.alias("g_start"), stop.alias("g_end"), F.when(F.col("kind") == "body", F.col("src_offset") + skip).otherwise(F.col("src_offset")).alias("src_offset"), skip.alias("skip"))


def by_volume(blocks: DataFrame, size: int) -> DataFrame:
    """Blocks cut at the borders of a regular grid, with vol_index."""
    hit = blocks.withColumn("vol_index", F.explode(F.sequence(F.floor(F.col("g_start") / size), F.floor((F.col("g_end") - 1) / size))))
    first, stop = F.greatest(F.col("g_start"), F.col("vol_index") * size), F.least(F.col("g_end"), (F.col("vol_index") + 1) * size)
    skip = first - F.col("g_start")
    return hit.select("vol_index", "arc_path", "rel_path", "kind", first.alias("g_start"), stop.alias("g_end"), F.when(F.col("kind") == "body", F.col("src_offset") + skip).otherwise(F.col("src_offset")).alias("src_offset"), skip.alias("skip"))


def zero_bytes(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n.cast("int")))


def events(tracks: DataFrame, start: int = 0) -> DataFrame:
    """The log of starts and ends of entries from an offset on, and its completion; data events are the block plan's rows.

    An entry is resumed if the stream begins beyond its start. Its end is complete only with a digest: it has content, and emission began no later than the content's first byte.
    """
    content = has_content(F.col("is_dir"), F.col("is_symlink")) & (F.col("size") > 0)
    rows = tracks.where(F.col("end_offset") > start)
    whole = content & (F.lit(start) <= header_end(F.col("start_offset")))
    none = lambda t: F.lit(None).cast(t)
    began = F.struct(F.lit(0).alias("rank"), F.lit("file_start").alias("type"), F.col("start_offset").alias("start_offset"), (F.lit(start) > F.col("start_offset")).alias("resumed"), none("long").alias("end_offset"), none("boolean").alias("is_complete"))
    ended = F.struct(F.lit(1).alias("rank"), F.lit("file_end").alias("type"), none("long").alias("start_offset"), none("boolean").alias("resumed"), F.col("end_offset").alias("end_offset"), whole.alias("is_complete"))
    log = rows.select("arc_path", F.col("start_offset").alias("at"), F.explode(F.array(began, ended)).alias("e")).select("at", "e.rank", "e.type", "arc_path", "e.start_offset", "e.resumed", "e.end_offset", "e.is_complete")
    done = tracks.agg((F.coalesce(F.max("end_offset"), F.lit(0)) + FOOTER).cast("long").alias("at")).select("at", F.lit(2).alias("rank"), F.lit("tape_completed").alias("type"), none("string").alias("arc_path"), none("long").alias("start_offset"), none("boolean").alias("resumed"), none("long").alias("end_offset"), none("boolean").alias("is_complete"))
    return log.union(done)


def padding_of(size: int) -> int:
    return -size % BLOCK
