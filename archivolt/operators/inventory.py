"""From what a scan found to an inventory: kinds, sizes, identity, exclusions, one row for each path."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import REPORT_ROWS
from ..errors import PathReportError
from ..functions.entries import effective_size, normalized_mode
from ..functions.paths import as_patterns, excluded, path_violation, truncate_path


def without_excluded(snapshot: DataFrame, exclude: str | Sequence[str] | Callable) -> DataFrame:
    """Rows of rel_path that neither match nor lie below a match. A callable path -> bool is a Python function, the one place where rows go to Python."""
    if not callable(exclude):
        return snapshot.where(~excluded(F.col("rel_path"), as_patterns(exclude)))
    from pathlib import PurePosixPath

    from ..constants import META_DIR

    @F.udf("boolean")
    def out(rel: str) -> bool:
        path = PurePosixPath(rel)
        parts = path.parts
        return META_DIR in parts or any(bool(exclude(PurePosixPath(*parts[: i + 1]))) for i in range(len(parts)))

    return snapshot.where((F.col("rel_path") == "") | ~out("rel_path"))


def supported(snapshot: DataFrame) -> DataFrame:
    return snapshot.where(F.col("is_dir") | F.col("is_file") | F.col("is_symlink"))


def arc_path(root_name: str, rel_path: Column) -> Column:
    return F.when(rel_path == "", F.lit(root_name)).otherwise(F.concat_ws("/", F.lit(root_name), rel_path))


def inventory(snapshot: DataFrame, root_name: str, exclude=(), anonymize: bool = True, auto_truncate: bool = False) -> DataFrame:
    """snapshot -> inventory rows, one for each supported path that is not excluded."""
    s = supported(without_excluded(snapshot, exclude))
    d, ln = F.col("is_dir"), F.col("is_symlink")
    path = arc_path(root_name, F.col("rel_path"))
    who = {c: F.lit(v) for c, v in (("uid", 0), ("gid", 0), ("uname", "root"), ("gname", "root"))} if anonymize else {c: F.col(c) for c in ("uid", "gid", "uname", "gname")}
    return s.select(
        (truncate_path(path) if auto_truncate else path).alias("arc_path"), "rel_path", effective_size(F.col("size"), d, ln).alias("size"), F.col("mtime").cast("long").alias("mtime"),
        (normalized_mode(F.col("mode"), d, ln) if anonymize else F.col("mode").cast("int")).alias("mode"), who["uid"].cast("long").alias("uid"), who["gid"].cast("long").alias("gid"),
        who["uname"].alias("uname"), who["gname"].alias("gname"), d.alias("is_dir"), ln.alias("is_symlink"), F.when(ln, F.coalesce("linkname", F.lit(""))).otherwise("").alias("linkname"), F.lit(None).cast("string").alias("md5sum"),
    )


def last_writer(rows: DataFrame, key: Sequence[str], seq: Sequence[Column]) -> DataFrame:
    """The last row of each key by seq."""
    w = W.partitionBy(*key).orderBy(*(c.desc() for c in seq))
    rank = "rank_" + "_".join(rows.columns)  # no column of rows
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def violations(inv: DataFrame) -> DataFrame:
    """arc_path, violation of the rows that can't be stored: limits, links and names too long, negative times, and paths that truncation made equal."""
    twice = inv.groupBy("arc_path").count().where("count > 1").select("arc_path", F.lit("paths collide").alias("violation"))
    why = F.coalesce(
        path_violation(F.col("arc_path"), F.col("is_dir")),
        F.when(F.octet_length("linkname") > 100, "link target too long"),
        F.when((F.octet_length("uname") > 32) | (F.octet_length("gname") > 32), "owner name too long"),
        F.when(F.col("mtime") < 0, "negative time"),
    )
    return inv.select("arc_path", why.alias("violation")).where("violation is not null").union(twice)


def raise_violations(inv: DataFrame, show: int = REPORT_ROWS) -> None:
    """One error for all, listing the first `show`."""
    found = violations(inv)
    first = found.orderBy("arc_path", "violation").limit(show).collect()  # at most `show` rows
    if not first:
        return
    rest = found.count() - len(first)
    lines = [f"{r['violation']}: {r['arc_path']}" for r in first] + [f"... and {rest} more"] * (rest > 0)
    raise PathReportError("\n".join(lines))


def encode_excludes(exclude: str | Sequence[str] | Callable) -> str:
    """Exclusions as they are stored: JSON, or the name of a callable."""
    if callable(exclude):
        return f"<dynamic_callable: {getattr(exclude, '__name__', 'callable')}>"
    return json.dumps(exclude if isinstance(exclude, str) else list(exclude))


def decode_excludes(stored: str):
    """Stored exclusions: a pattern, a list of them, or the text as it is where it isn't JSON."""
    try:
        return json.loads(stored)
    except ValueError:
        return stored
