"""The byte layout of a stream: prefix sums in path order, statistics, fingerprint, lookups."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import FOOTER
from ..errors import OffsetError
from ..functions.entries import block_size, contains, has_content, identity_text

#: Rows up to which one task orders the whole inventory; beyond, ranges are summed first.
ONE_TASK_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where it is unset, a temporary folder, in local mode only."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("archivolt.plan.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="archivolt-")
        spark.conf.set("archivolt.plan.dir", where)
    return where.rstrip("/")


def layout(inventory: DataFrame, ranges: int | None = None, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """inventory -> tracks: start_offset and end_offset of every entry, in bytewise order of arc_path.

    Beyond one_task_rows the rows are dealt by path range and written once (range bounds come from sampling, so they must not be computed again);
    the few totals by range are summed and broadcast, and each range is summed on its own.
    """
    size = block_size(F.col("size"), has_content(F.col("is_dir"), F.col("is_symlink")))
    inv = inventory.withColumn("block_size", size)
    before = (W.unboundedPreceding, -1)
    if ranges is None and inventory.limit(one_task_rows + 1).count() <= one_task_rows:
        start = F.coalesce(F.sum("block_size").over(W.orderBy("arc_path").rowsBetween(*before)), F.lit(0).cast("long"))
        return inv.withColumn("start_offset", start).withColumn("end_offset", F.col("start_offset") + F.col("block_size")).drop("block_size")
    spark = inventory.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/layout-{uuid.uuid4().hex}"
    inv.repartitionByRange(n, "arc_path").withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    totals = dealt.groupBy("_range").agg(F.sum("block_size").alias("t"))  # a row for each range
    base = totals.select("_range", F.coalesce(F.sum("t").over(W.orderBy("_range").rowsBetween(*before)), F.lit(0).cast("long")).alias("_base"))
    own = F.coalesce(F.sum("block_size").over(W.partitionBy("_range").orderBy("arc_path").rowsBetween(*before)), F.lit(0).cast("long"))
    out = dealt.withColumn("_own", own).join(F.broadcast(base), "_range").withColumn("start_offset", F.col("_base") + F.col("_own"))
    return out.withColumn("end_offset", F.col("start_offset") + F.col("block_size")).drop("_range", "_base", "_own", "block_size")


def total_size(tracks: DataFrame) -> DataFrame:
    return tracks.agg((F.coalesce(F.max("end_offset"), F.lit(0)) + FOOTER).cast("long").alias("total_size"))


def fingerprint(inventory: DataFrame) -> str:
    """SHA-256 over the identities in path order. A digest is sequential: sorted partitions stream through the driver, one at a time."""
    h = hashlib.sha256()
    for row in inventory.orderBy("arc_path").select(identity_text(F.col("arc_path"), F.col("size"), F.col("mtime"))).toLocalIterator():
        h.update(row[0].encode())
    return h.hexdigest()


def stats(tracks: DataFrame, created_at: int = 0, excludes: str = "[]") -> DataFrame:
    """One row: fingerprint, total_size, created_at, exclude_patterns, track_count."""
    sums = tracks.agg((F.coalesce(F.max("end_offset"), F.lit(0)) + FOOTER).cast("long").alias("total_size"), F.count("*").alias("track_count"))
    return sums.select(F.lit(fingerprint(tracks)).alias("fingerprint"), "total_size", F.lit(created_at).cast("long").alias("created_at"), F.lit(excludes).alias("exclude_patterns"), "track_count")


def stats_map(row: dict) -> dict:
    """Stored values with the defaults of missing ones."""
    defaults = {"fingerprint": "", "total_size": 0, "created_at": 0, "exclude_patterns": "", "track_count": 0}
    return {k: d if row.get(k) is None else row[k] for k, d in defaults.items()}


def tracks_from(tracks: DataFrame, offset: int) -> DataFrame:
    """Entries that end beyond an offset, in order; the filter reaches the scan of a stored table."""
    return tracks.where(F.col("end_offset") > offset).orderBy("start_offset")


def track_at(tracks: DataFrame, offset: int) -> DataFrame:
    """The entry whose bytes hold an offset, or no row (the footer, or outside)."""
    return tracks.where(contains(F.col("start_offset"), F.col("end_offset"), F.lit(offset)))


def tracks_at(tracks: DataFrame, offsets) -> DataFrame:
    """byte and the entry that holds it, for each of a few offsets, by one pass over the entries; an offset that no entry holds has no row."""
    inside = F.filter(F.array(*map(F.lit, offsets)).cast("array<long>"), lambda o: contains(F.col("start_offset"), F.col("end_offset"), o))
    return tracks.select(F.explode(inside).alias("byte"), *tracks.columns)


def grid_points(tracks: DataFrame, step: int) -> DataFrame:
    """byte and the entry that holds it, for every multiple of step inside an entry: the points grow with the stream, at the cost of one pass."""
    first, last = F.ceil(F.col("start_offset") / step), F.floor((F.col("end_offset") - 1) / step)
    points = F.when(first <= last, F.transform(F.sequence(first, last), lambda v: v * step))
    return tracks.select(F.explode(points).alias("byte"), *tracks.columns)


def check_offset(offset: int, total: int) -> None:
    if not 0 <= offset < total:
        raise OffsetError(f"offset {offset} is outside the stream of {total} bytes")
