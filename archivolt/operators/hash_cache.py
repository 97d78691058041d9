"""Content digests remembered by (arc_path, size, mtime), and which cache files to drop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import CACHE_MAX_BYTES, CACHE_MAX_FILES

KEY = ["arc_path", "size", "mtime"]


def probe(inv: DataFrame, cache: DataFrame) -> DataFrame:
    """inventory with md5sum of the cache where all three keys agree, and whether it was a hit. Only regular files are looked up."""
    held = cache.select(*KEY, F.col("md5sum").alias("_md5"))
    joined = inv.join(held, KEY, "left")
    hit = ~F.col("is_dir") & ~F.col("is_symlink") & F.col("_md5").isNotNull()
    return joined.withColumn("md5sum", F.when(hit, F.col("_md5")).otherwise(F.col("md5sum"))).withColumn("hit", hit).drop("_md5")


def merged(cache: DataFrame, new: DataFrame) -> DataFrame:
    """cache with new digests; a new one replaces an old one of its key."""
    rows = cache.select(*KEY, "md5sum").join(new.select(*KEY), KEY, "left_anti")
    return rows.union(new.select(*KEY, "md5sum"))


def evictions(listing: DataFrame, most_files: int = CACHE_MAX_FILES, most_bytes: int = CACHE_MAX_BYTES) -> DataFrame:
    """listing (name, mtime, size) -> the files to drop: the oldest, as long as files or bytes are above their limits. A listing is one folder's."""
    order = W.orderBy("mtime", "name")
    whole = W.partitionBy()
    seen = listing.select("name", "mtime", "size", F.row_number().over(order).alias("rn"), F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("freed"), F.count("*").over(whole).alias("n"), F.sum("size").over(whole).alias("bytes"))
    return seen.where((F.col("n") - (F.col("rn") - 1) > most_files) | (F.col("bytes") - F.col("freed") > most_bytes)).select("name", "mtime", "size")
