"""The registered queries of the archive engine, over the driver's tables read as files, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import DEFAULT_EXCLUDES
from ..functions import entries as en
from ..functions import header as hd
from ..functions import paths as pa
from ..operators import hash_cache, integrity
from ..operators import inventory as inv
from ..sources import content
from . import blocks as blk
from . import layout as lay
from . import volumes as vol

VOLUME = 65536
FIXED_TIME = 1700000000
RESUME = 200001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a folder tree: <source>/<lang>/<doc_id>.txt with the text as content; modes, owners and links made up from the id."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    link = i % 97 == 5
    files = d.select(
        F.concat_ws("/", "source", "lang", F.concat(i.cast("string"), F.lit(".txt"))).alias("rel_path"), F.octet_length("text").cast("long").alias("size"), (i + FIXED_TIME).alias("mtime"),
        F.when(i % 7 == 0, 0o751).when(i % 7 == 1, 0o666).otherwise(0o600).cast("int").alias("mode"), (i % 5 + 1000).alias("uid"), (i % 3 + 100).alias("gid"), F.concat(F.lit("user"), (i % 5).cast("string")).alias("uname"), F.concat(F.lit("group"), (i % 3).cast("string")).alias("gname"),
        F.lit(False).alias("is_dir"), ((i % 101 != 7) & ~link).alias("is_file"), link.alias("is_symlink"), F.when(link, F.concat(F.lit("../"), "lang", F.lit("/target"))).otherwise("").alias("linkname"),
    )
    tops = d.select(F.col("source").alias("rel_path")).distinct()
    subs = d.select(F.concat_ws("/", "source", "lang").alias("rel_path")).distinct()
    names = tops.union(subs).union(spark.range(1).select(F.lit("").alias("rel_path")))
    none = F.lit(0).cast("long")
    dirs = names.select("rel_path", none.alias("size"), F.lit(FIXED_TIME).cast("long").alias("mtime"), F.lit(0o700).alias("mode"), none.alias("uid"), none.alias("gid"), F.lit("root").alias("uname"), F.lit("wheel").alias("gname"), F.lit(True).alias("is_dir"), F.lit(False).alias("is_file"), F.lit(False).alias("is_symlink"), F.lit("").alias("linkname"))
    return files.union(dirs)


def corpus(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return inv.inventory(snapshot(spark, sf_dir), "corpus", **options)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lay.layout(corpus(spark, sf_dir))


def _total(t: DataFrame) -> int:
    return lay.total_size(t).first()[0]


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("corpus/"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))).alias("arc_path"), F.encode("text", "UTF-8").alias("content"))


SNAPSHOT_SQL = f"""
f AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS rel_path, strlen(text)::BIGINT AS size, doc_id + {FIXED_TIME} AS mtime,
  CASE WHEN doc_id % 7 = 0 THEN 489 WHEN doc_id % 7 = 1 THEN 438 ELSE 384 END AS mode, doc_id % 5 + 1000 AS uid, doc_id % 3 + 100 AS gid, 'user' || doc_id % 5 AS uname, 'group' || doc_id % 3 AS gname,
  false AS is_dir, doc_id % 101 <> 7 AND doc_id % 97 <> 5 AS is_file, doc_id % 97 = 5 AS is_symlink, CASE WHEN doc_id % 97 = 5 THEN '../' || lang || '/target' ELSE '' END AS linkname, text FROM documents),
names AS (SELECT DISTINCT source AS r FROM documents UNION SELECT DISTINCT source || '/' || lang FROM documents UNION SELECT ''),
snap AS (SELECT * FROM f UNION ALL SELECT r, 0, {FIXED_TIME}, 448, 0, 0, 'root', 'wheel', true, false, false, '', '' FROM names)"""
INV_SQL = (
    SNAPSHOT_SQL
    + """,
inv AS (SELECT CASE WHEN rel_path = '' THEN 'corpus' ELSE 'corpus/' || rel_path END AS arc_path, rel_path, CASE WHEN is_dir OR is_symlink THEN 0 ELSE size END AS size, mtime,
  CASE WHEN is_dir THEN 493 WHEN is_symlink THEN 511 WHEN mode & 73 <> 0 THEN 493 ELSE 420 END AS mode, is_dir, is_symlink, linkname, text FROM snap WHERE is_dir OR is_file OR is_symlink)"""
)
LAY_SQL = (
    INV_SQL
    + """,
lay AS (SELECT *, 512 + size + (512 - size % 512) % 512 AS blk FROM inv),
t AS (SELECT *, coalesce(sum(blk) OVER (ORDER BY arc_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset,
  (sum(blk) OVER (ORDER BY arc_path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS end_offset FROM lay),
tot AS (SELECT max(end_offset) + 1024 AS total FROM t)"""
)
_NAME = "CASE WHEN is_dir THEN arc_path || '/' ELSE arc_path END"
_OCT = lambda c, w: f"hex(encode(lpad(to_base({c}, 8), {w - 1}, '0'))) || '00'"
HEAD_SQL = (
    LAY_SQL
    + f""",
parts AS (SELECT *, rpad(hex(encode({_NAME})), 200, '0') || {_OCT("mode", 8)} || {_OCT("0", 8)} || {_OCT("0", 8)} || {_OCT("size", 12)} || {_OCT("mtime", 12)} AS pre,
  CASE WHEN is_dir THEN '35' WHEN is_symlink THEN '32' ELSE '30' END || rpad(hex(encode(linkname)), 200, '0') || '7573746172003030' || rpad('726F6F74', 64, '0') || rpad('726F6F74', 64, '0') || repeat('00', 16) || repeat('00', 155) || repeat('00', 12) AS post FROM t),
sums AS (SELECT *, (256 + list_sum(list_transform(range(0, 504), lambda i: CAST('0x' || substr(pre || post, i * 2 + 1, 2) AS INT))))::BIGINT AS checksum FROM parts),
heads AS (SELECT *, lower(pre || hex(encode(lpad(to_base(checksum, 8), 6, '0'))) || '0020' || post) AS header FROM sums)"""
)
VOL_SQL = (
    LAY_SQL
    + f""",
m AS (SELECT t.*, v AS vol_index, v * {VOLUME} AS vol_start, least((v + 1) * {VOLUME}, total) AS vol_end FROM t, tot, (SELECT unnest(range(0, (SELECT (total + {VOLUME} - 1) // {VOLUME} FROM tot))) AS v)
  WHERE start_offset < least((v + 1) * {VOLUME}, total) AND end_offset > v * {VOLUME}),
man AS (SELECT *, CASE WHEN start_offset >= vol_start AND end_offset <= vol_end THEN 'complete' WHEN start_offset >= vol_start THEN 'head' WHEN end_offset <= vol_end THEN 'tail' ELSE 'body' END AS state,
  greatest(0, greatest(start_offset, vol_start) - vol_start) AS local_start, greatest(0, least(end_offset, vol_end) - vol_start) AS local_end FROM m)"""
)
BLOCK_SQL = (
    LAY_SQL
    + """,
b AS (SELECT arc_path, 'header' AS kind, start_offset AS a, start_offset + 512 AS z FROM t UNION ALL SELECT arc_path, 'body', start_offset + 512, start_offset + 512 + size FROM t WHERE size > 0
  UNION ALL SELECT arc_path, 'padding', start_offset + 512 + size, end_offset FROM t WHERE end_offset > start_offset + 512 + size UNION ALL SELECT NULL, 'footer', total - 1024, total FROM tot)"""
)
#: All bytes of the stream as one hex string, for small tables only.
BYTES_SQL = (
    HEAD_SQL
    + """,
x AS (SELECT string_agg(header || lower(CASE WHEN size > 0 THEN hex(encode(text)) ELSE '' END) || repeat('00', ((512 - size % 512) % 512)::INT), '' ORDER BY arc_path) || repeat('00', 1024) AS hx FROM heads)"""
)


def long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with long components, from text beginnings."""
    d = table(spark, sf_dir, "documents")
    part = F.replace(F.replace(F.left("text", (F.col("doc_id") % 140 + 1).cast("int")), F.lit("/"), F.lit("_")), F.lit("\n"), F.lit(" "))
    return d.select("doc_id", F.concat_ws("/", F.lit("corpus"), "source", "lang", part, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))


LONG_SQL = "ln AS (SELECT doc_id, 'corpus/' || source || '/' || lang || '/' || replace(replace(left(text, (doc_id % 140 + 1)::INT), '/', '_'), chr(10), ' ') || '/' || doc_id || '.txt' AS path FROM documents)"
_TRUNC = "list_transform(string_split(path, '/'), lambda c: CASE WHEN strlen(c) > 100 THEN left(c, list_max(list_filter(range(0, 86), lambda k: strlen(left(c, k)) <= 85))) || '_' || left(md5(c), 14) ELSE c END)"
_CUT = "list_filter(range(1, length(path)), lambda i: substr(path, i, 1) = '/' AND strlen(left(path, i - 1)) <= 155 AND strlen(substr(path, i + 1)) <= 100)"


def _now(t: DataFrame) -> DataFrame:
    """A later look at the tracks: some files gone, touched or grown, some folders changed, by the mtime's remainder."""
    m = F.col("mtime") - FIXED_TIME
    file = ~F.col("is_dir")
    return t.where(~(file & (m % 31 == 3))).select("rel_path", F.lit(True).alias("exists"), (F.col("mtime") + F.when(file & (m % 29 == 4), 100).when(F.col("is_dir") & F.col("rel_path").endswith("de"), 500).otherwise(0)).alias("mtime"), (F.col("size") + F.when(file & (m % 23 == 6), 1).otherwise(0)).alias("size"))


_NOW_SQL = f""",
now AS (SELECT rel_path AS r, mtime + CASE WHEN NOT is_dir AND (mtime - {FIXED_TIME}) % 29 = 4 THEN 100 WHEN is_dir AND rel_path LIKE '%de' THEN 500 ELSE 0 END AS m1, size + CASE WHEN NOT is_dir AND (mtime - {FIXED_TIME}) % 23 = 6 THEN 1 ELSE 0 END AS s1
  FROM t WHERE is_dir OR (mtime - {FIXED_TIME}) % 31 <> 3),
bad AS (SELECT arc_path, CASE WHEN r IS NULL THEN 'File missing' WHEN is_dir THEN CASE WHEN rel_path <> '' AND m1 <> mtime THEN 'Directory structure changed' END WHEN m1 <> mtime THEN 'File modified (mtime)' WHEN NOT is_symlink AND s1 <> size THEN 'File size changed' END AS violation
  FROM t LEFT JOIN now ON rel_path = r)"""

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"WITH {LONG_SQL} SELECT doc_id, len(string_split(path, '/')) AS n_parts, list_max(list_transform(string_split(path, '/'), lambda c: strlen(c))) AS longest FROM ln")
def path_components(spark, sf):
    p = pa.components(F.col("path"))
    return long_names(spark, sf).select("doc_id", F.size(p).cast("long").alias("n_parts"), F.array_max(F.transform(p, lambda c: F.octet_length(c))).cast("long").alias("longest"))


@query(f"WITH {LONG_SQL} SELECT doc_id, strlen(path)::BIGINT AS n_bytes, CASE WHEN strlen(path) > 255 THEN 'path too long' WHEN list_max(list_transform(string_split(path, '/'), lambda c: strlen(c))) > 100 THEN 'component too long' WHEN strlen(path) > 100 AND len({_CUT}) = 0 THEN 'path cannot be split' END AS violation FROM ln")
def path_byte_limits(spark, sf):
    return long_names(spark, sf).select("doc_id", F.octet_length("path").cast("long").alias("n_bytes"), pa.path_violation(F.col("path")).alias("violation"))


@query(f"WITH {LONG_SQL} SELECT doc_id, array_to_string({_TRUNC}, '/') AS path FROM ln")
def path_truncate(spark, sf):
    return long_names(spark, sf).select("doc_id", pa.truncate_path(F.col("path")).alias("path"))


@query(f"WITH {LONG_SQL}, c AS (SELECT *, list_max({_CUT}) AS cut FROM ln) SELECT doc_id, CASE WHEN strlen(path) <= 100 THEN path ELSE substr(path, cut + 1) END AS name, CASE WHEN strlen(path) <= 100 THEN '' ELSE left(path, cut - 1) END AS prefix FROM c")
def ustar_split(spark, sf):
    name, prefix = pa.ustar_split(F.col("path"))
    return long_names(spark, sf).select("doc_id", name.alias("name"), F.when(name.isNotNull(), prefix).alias("prefix"))


@query(f"WITH {LONG_SQL}, c AS (SELECT path AS arc_path, CASE WHEN strlen(path) > 255 THEN 'path too long' WHEN list_max(list_transform(string_split(path, '/'), lambda c: strlen(c))) > 100 THEN 'component too long' WHEN strlen(path) > 100 AND len({_CUT}) = 0 THEN 'path cannot be split' END AS violation FROM ln) SELECT * FROM c WHERE violation IS NOT NULL")
def path_violations_report(spark, sf):
    rows = long_names(spark, sf).select(F.col("path").alias("arc_path"), F.lit(False).alias("is_dir"), F.lit("").alias("linkname"), F.lit("root").alias("uname"), F.lit("root").alias("gname"), F.lit(0).cast("long").alias("mtime"))
    return inv.violations(rows)


_EV_SQL = "ev AS (SELECT event_id, event_type || '/' || CASE event_id % 6 WHEN 0 THEN 'note.sock' WHEN 1 THEN '__pycache__/m.pyc' WHEN 2 THEN 'x.db-wal' WHEN 3 THEN 'data[1].txt' WHEN 4 THEN 'Thumbs.db' ELSE 'keep/thumbs.db' END AS rel_path FROM events)"


def _event_paths(spark, sf):
    i = F.col("event_id") % 6
    name = F.when(i == 0, "note.sock").when(i == 1, "__pycache__/m.pyc").when(i == 2, "x.db-wal").when(i == 3, "data[1].txt").when(i == 4, "Thumbs.db").otherwise("keep/thumbs.db")
    return table(spark, sf, "events").select("event_id", F.concat_ws("/", "event_type", name).alias("rel_path"))


@query(f"WITH {_EV_SQL} SELECT event_id, regexp_matches(rel_path, '(^|/)(\\.DS_Store|Thumbs\\.db|__pycache__|[^/]*\\.db-wal|[^/]*\\.db-shm|[^/]*\\.sock)$') AS excluded FROM ev")
def exclude_glob(spark, sf):
    return _event_paths(spark, sf).select("event_id", pa.excluded_itself(F.col("rel_path"), DEFAULT_EXCLUDES).alias("excluded"))


@query(f"WITH {_EV_SQL} SELECT event_id, rel_path FROM ev WHERE NOT regexp_matches(rel_path, '(^|/)(\\.DS_Store|Thumbs\\.db|__pycache__|[^/]*\\.db-wal|[^/]*\\.db-shm|[^/]*\\.sock)(/|$)')")
def exclude_subtree(spark, sf):
    return inv.without_excluded(_event_paths(spark, sf), DEFAULT_EXCLUDES)


@query(f"WITH {SNAPSHOT_SQL} SELECT rel_path, CASE WHEN is_dir THEN 493 WHEN is_symlink THEN 511 WHEN mode & 73 <> 0 THEN 493 ELSE 420 END AS mode FROM snap")
def inventory_normalized_mode(spark, sf):
    return snapshot(spark, sf).select("rel_path", en.normalized_mode(F.col("mode"), F.col("is_dir"), F.col("is_symlink")).alias("mode"))


@query(f"WITH {INV_SQL} SELECT arc_path, size, mtime, mode, 0 AS uid, 0 AS gid, 'root' AS uname, 'root' AS gname, linkname FROM inv")
def anonymized_inventory(spark, sf):
    return corpus(spark, sf).select("arc_path", "size", "mtime", "mode", "uid", "gid", "uname", "gname", "linkname")


@query(f"WITH {SNAPSHOT_SQL} SELECT 'corpus' || CASE WHEN rel_path = '' THEN '' ELSE '/' || rel_path END AS arc_path, mode, uid, gid, uname, gname FROM snap WHERE is_dir OR is_file OR is_symlink")
def raw_inventory(spark, sf):
    return corpus(spark, sf, anonymize=False).select("arc_path", "mode", "uid", "gid", "uname", "gname")


@query(f"WITH {INV_SQL} SELECT CASE WHEN is_dir THEN 'dir' WHEN is_symlink THEN 'symlink' ELSE 'file' END AS kind, count(*) AS n, sum(size)::BIGINT AS bytes FROM inv GROUP BY kind")
def entry_kinds(spark, sf):
    return corpus(spark, sf).groupBy(en.entry_kind(F.col("is_dir"), F.col("is_symlink")).alias("kind")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"WITH {INV_SQL} SELECT arc_path, (512 - size % 512) % 512 AS padding, 512 + size + (512 - size % 512) % 512 AS block_size FROM inv")
def padding_and_blocks(spark, sf):
    c = en.has_content(F.col("is_dir"), F.col("is_symlink"))
    return corpus(spark, sf).select("arc_path", en.padding_size(F.col("size"), c).alias("padding"), en.block_size(F.col("size"), c).alias("block_size"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1")
def dedupe_last_writer(spark, sf):
    return inv.last_writer(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"WITH {LAY_SQL} SELECT arc_path, start_offset, end_offset FROM t")
def tape_layout(spark, sf):
    return tracks(spark, sf).select("arc_path", "start_offset", "end_offset")


@query(f"WITH {LAY_SQL} SELECT arc_path, start_offset, end_offset FROM t")
def tape_layout_by_ranges(spark, sf):
    return lay.layout(corpus(spark, sf), one_task_rows=0).select("arc_path", "start_offset", "end_offset")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as an inventory, a file for each different line."""
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity").cast("long") * 37).alias("size")).distinct()
    path = F.concat_ws("/", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return b.select(path.alias("arc_path"), "size", F.lit(False).alias("is_dir"), F.lit(False).alias("is_symlink"))


@query("WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) * 37 AS size FROM lineitem), p AS (SELECT lpad(l_orderkey::VARCHAR, 12, '0') || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS arc_path, sum(512 + size + (512 - size % 512) % 512)::BIGINT AS block FROM (SELECT DISTINCT * FROM b) GROUP BY 1) SELECT count(*) AS n, sum(block)::BIGINT + 1024 AS total_size, max(block) AS largest FROM p")
def large_layout_size(spark, sf):
    t = lay.layout(_lines(spark, sf))
    p = t.groupBy("arc_path").agg(F.sum(F.col("end_offset") - F.col("start_offset")).alias("block"), F.max("end_offset").alias("end"))
    return p.agg(F.count("*").alias("n"), (F.max("end") + 1024).alias("total_size"), F.max("block").alias("largest"))


@query("WITH p AS (SELECT lpad(l_orderkey::VARCHAR, 12, '0') || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS arc_path, max(CAST(l_quantity AS BIGINT) * 37) AS size FROM lineitem GROUP BY 1), b AS (SELECT arc_path, 512 + size + (512 - size % 512) % 512 AS block FROM p) SELECT arc_path, (sum(block) OVER (ORDER BY arc_path) - block)::BIGINT AS start_offset, (sum(block) OVER (ORDER BY arc_path))::BIGINT AS end_offset FROM b")
def large_layout(spark, sf):
    """Offsets of the lineitem entries, beyond layout's one-task limit from sf0.1 on; of equal paths the largest size."""
    return lay.layout(_lines(spark, sf).groupBy("arc_path", "is_dir", "is_symlink").agg(F.max("size").alias("size"))).select("arc_path", "start_offset", "end_offset")


@query(f"WITH {LAY_SQL} SELECT arc_path, start_offset + 512 AS header_end, start_offset + 512 + size AS content_end FROM t")
def tape_offsets(spark, sf):
    c = en.has_content(F.col("is_dir"), F.col("is_symlink"))
    return tracks(spark, sf).select("arc_path", en.header_end(F.col("start_offset")).alias("header_end"), en.content_end(F.col("start_offset"), F.col("size"), c).alias("content_end"))


_FP = "sha256(string_agg(arc_path || '|' || size || '|' || mtime, '' ORDER BY arc_path))"


@query(f"WITH {LAY_SQL} SELECT {_FP} AS fingerprint, max(end_offset) + 1024 AS total_size, 0::BIGINT AS created_at, '[]' AS exclude_patterns, count(*) AS track_count FROM t")
def tape_stats(spark, sf):
    return lay.stats(tracks(spark, sf))


@query(f"WITH {LAY_SQL} SELECT {_FP} AS fingerprint FROM t")
def fingerprint(spark, sf):
    return spark.range(1).select(F.lit(lay.fingerprint(corpus(spark, sf))).alias("fingerprint"))


_POINTS = (0, 511, 512, 22000, 70000, 1234567)
_RESUMES = tuple(range(0, 3_000_000, 41_003))


@query(f"WITH {LAY_SQL} SELECT p AS byte, arc_path FROM t, (SELECT unnest({list(_POINTS)}) AS p) WHERE start_offset <= p AND end_offset > p")
def point_lookup(spark, sf):
    return lay.tracks_at(tracks(spark, sf), _POINTS).select("byte", "arc_path")


@query(f"WITH {LAY_SQL} SELECT arc_path, start_offset FROM t WHERE end_offset > {RESUME}")
def tracks_from_offset(spark, sf):
    return lay.tracks_from(tracks(spark, sf), RESUME).select("arc_path", "start_offset")


@query(f"WITH {HEAD_SQL} SELECT arc_path, header FROM heads")
def header_hex(spark, sf):
    return corpus(spark, sf).select("arc_path", hd.header_hex(hd.entry_columns()).alias("header"))


@query(f"WITH {HEAD_SQL} SELECT arc_path, checksum FROM heads")
def header_checksum(spark, sf):
    return corpus(spark, sf).select("arc_path", hd.header_checksum(hd.entry_columns()).alias("checksum"))


@query(f"WITH {HEAD_SQL} SELECT is_dir, is_symlink, md5(string_agg(md5(unhex(header)), '' ORDER BY arc_path)) AS digest FROM heads GROUP BY ALL")
def header_md5_by_type(spark, sf):
    rows = corpus(spark, sf).select("arc_path", "is_dir", "is_symlink", F.md5(F.unhex(hd.header_hex(hd.entry_columns()))).alias("m"))
    return rows.groupBy("is_dir", "is_symlink").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("arc_path", "m"))), lambda x: x["m"]), "").cast("binary")).alias("digest"))


@query("SELECT l_orderkey, l_linenumber, s AS size, CASE WHEN s <= 8589934591 THEN hex(encode(lpad(to_base(s, 8), 11, '0'))) || '00' ELSE '80' || lpad(printf('%X', s), 22, '0') END AS field FROM (SELECT DISTINCT l_orderkey, l_linenumber, (l_partkey * l_suppkey + l_orderkey) * 100003 AS s FROM lineitem)")
def size_field(spark, sf):
    s = (F.col("l_partkey") * F.col("l_suppkey") + F.col("l_orderkey")) * 100003
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", s.alias("size")).distinct().select("*", hd.size_field(F.col("size")).alias("field"))


@query(f"WITH {SNAPSHOT_SQL} SELECT rel_path, {_OCT('mode', 8)} AS field FROM snap")
def mode_octal(spark, sf):
    return snapshot(spark, sf).select("rel_path", hd.octal_field(F.col("mode"), 8).alias("field"))


@query(f"WITH {LAY_SQL} SELECT v AS vol_index, v * {VOLUME} AS vol_start, least((v + 1) * {VOLUME}, total) AS vol_end FROM tot, (SELECT unnest(range(0, (SELECT (total + {VOLUME} - 1) // {VOLUME} FROM tot))) AS v)")
def segments(spark, sf):
    return vol.segments(spark, _total(tracks(spark, sf)), VOLUME)


@query(f"WITH {VOL_SQL} SELECT vol_index, vol_start, vol_end, arc_path, state, start_offset, end_offset, local_start, local_end FROM man")
def volume_manifest(spark, sf):
    t = tracks(spark, sf)
    return vol.manifest(t, _total(t), VOLUME).select("vol_index", "vol_start", "vol_end", "arc_path", "state", "start_offset", "end_offset", "local_start", "local_end")


@query(f"WITH {VOL_SQL} SELECT vol_index, state, count(*) AS n, sum(local_end - local_start)::BIGINT AS bytes FROM man GROUP BY ALL")
def volume_state_counts(spark, sf):
    return volume_manifest(spark, sf).groupBy("vol_index", "state").agg(F.count("*").alias("n"), F.sum(F.col("local_end") - F.col("local_start")).alias("bytes"))


@query(f"WITH {LAY_SQL}, fp AS (SELECT {_FP} AS fp FROM t), n AS (SELECT (total + {VOLUME} - 1) // {VOLUME} AS n FROM tot) SELECT v AS vol_index, 'corpus_' || left(fp, 8) || '.tar.' || lpad((v + 1)::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS vol_name FROM fp, n, (SELECT unnest(range(0, (SELECT n FROM n))) AS v)")
def volume_names(spark, sf):
    t = tracks(spark, sf)
    total = _total(t)
    return vol.segments(spark, total, VOLUME).select("vol_index", vol.volume_name(F.col("vol_index"), (total + VOLUME - 1) // VOLUME, "corpus", lay.fingerprint(t)).alias("vol_name"))


@query(f"WITH {LAY_SQL} SELECT arc_path, CASE WHEN start_offset >= 100001 AND end_offset <= 300003 THEN 'complete' WHEN start_offset >= 100001 THEN 'head' WHEN end_offset <= 300003 THEN 'tail' ELSE 'body' END AS state, greatest(start_offset, 100001) - 100001 AS local_start, least(end_offset, 300003) - 100001 AS local_end FROM t WHERE start_offset < 300003 AND end_offset > 100001")
def volume_window_offgrid(spark, sf):
    t = tracks(spark, sf)
    return vol.window_manifest(t, 100001, 300003, _total(t)).select("arc_path", "state", "local_start", "local_end")


@query(f"WITH {VOL_SQL} SELECT vol_index, vol_start, vol_end, row_number() OVER (PARTITION BY vol_index ORDER BY start_offset) - 1 AS seq, start_offset AS at, arc_path, rel_path, size, mtime, mode, is_dir, is_symlink, linkname, state, start_offset, end_offset, local_start, local_end FROM man")
def volume_nested_manifest(spark, sf):
    """The nested manifests, unnested again with each entry's place in its volume."""
    t = tracks(spark, sf)
    rows = vol.nested(vol.manifest(t, _total(t), VOLUME)).select("vol_index", "vol_start", "vol_end", F.posexplode("entries").alias("seq", "e"))
    info = ("arc_path", "rel_path", "size", "mtime", "mode", "is_dir", "is_symlink", "linkname")
    windows = (("global_window", "start_offset", "end_offset"), ("local_window", "local_start", "local_end"))
    return rows.select("vol_index", "vol_start", "vol_end", F.col("seq").cast("long").alias("seq"), "e.at", *(F.col(f"e.info.{c}") for c in info), "e.state", *(F.col(f"e.{w}.{x}").alias(n) for w, *names in windows for x, n in zip(("start", "end"), names, strict=True)))


@query(f"WITH {LAY_SQL}, n AS (SELECT (total + {VOLUME} - 1) // {VOLUME} AS n FROM tot) SELECT v AS vol_index, 'corpus-' || (v + 1) || '-of-' || n || '.' || lpad((v + 1)::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS vol_name FROM n, (SELECT unnest(range(0, (SELECT n FROM n))) AS v)")
def volume_template_names(spark, sf):
    """Names of all volumes by a template; there are as many as volumes."""
    n = (_total(tracks(spark, sf)) + VOLUME - 1) // VOLUME
    return spark.createDataFrame([(i, vol.named(i, n, "corpus", "", "{name}-{part}-of-{total}.{pindex}")) for i in range(n)], "vol_index long, vol_name string")


@query(f"WITH {LAY_SQL} SELECT row_number() OVER (ORDER BY arc_path) - 1 AS seq, arc_path FROM t")
def listing_by_path(spark, sf):
    """The listing in path order, with the place that an ordered read gives each entry."""
    return _numbered(tracks(spark, sf).orderBy("arc_path").select("arc_path"))


@query(f"WITH {LAY_SQL} SELECT row_number() OVER (ORDER BY start_offset) - 1 AS seq, arc_path, start_offset FROM t WHERE end_offset > {RESUME}")
def listing_from_offset(spark, sf):
    return _numbered(lay.tracks_from(tracks(spark, sf), RESUME).select("arc_path", "start_offset"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with the place at which a reader meets them: sorted partitions one after the other."""
    path = f"{lay.shared_folder(rows.sparkSession)}/listing-{uuid.uuid4().hex}"
    rows.withColumns({"part": F.spark_partition_id(), "in_part": F.monotonically_increasing_id()}).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path)
    sizes = placed.groupBy("part").count()  # a row for each partition
    base = sizes.select("part", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.col("in_part").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(base), "part").select((F.col("base") + own).alias("seq"), *rows.columns)


@query("SELECT * FROM (VALUES ('fingerprint', ''), ('total_size', '7'), ('created_at', '0'), ('exclude_patterns', ''), ('track_count', '0')) AS v(name, value)")
def stats_defaults(spark, sf):
    """What stored statistics give for values that are missing or null."""
    return spark.createDataFrame([(k, str(v)) for k, v in lay.stats_map({"total_size": 7, "created_at": None}).items()], "name string, value string")


@query("SELECT range AS seq, (['.DS_Store', 'Thumbs.db', '__pycache__', '*.db-wal', '*.db-shm', '*.sock', 'a\"b,c', 'ñ'])[range + 1] AS pattern FROM range(8)")
def exclude_codec(spark, sf):
    """Exclusion patterns after they were stored and read."""
    back = inv.decode_excludes(inv.encode_excludes([*DEFAULT_EXCLUDES, 'a"b,c', "ñ"]))
    return spark.createDataFrame(list(enumerate(back)), "seq long, pattern string")


@query(f"WITH {SNAPSHOT_SQL} SELECT rel_path, CASE WHEN rel_path = '' THEN '/data/corpus' ELSE '/data/corpus/' || rel_path END AS path FROM snap")
def absolute_paths(spark, sf):
    return snapshot(spark, sf).select("rel_path", en.absolute_path("/data/corpus", F.col("rel_path")).alias("path"))


@query(f"WITH {HEAD_SQL} SELECT arc_path, substr(header, 1, 200) || '3030303036303000' || substr(header, 217) AS header FROM heads")
def header_set_bytes(spark, sf):
    """Headers with another mode written over them."""
    t = corpus(spark, sf)
    return t.select("arc_path", F.lower(hd.set_bytes(hd.header_hex(hd.entry_columns()), 100, hd.octal_field(F.lit(0o600), 8))).alias("header"))


@query(f"WITH {LAY_SQL} SELECT rel_path FROM t WHERE mtime % 31 = 3 UNION ALL SELECT 'new/' || doc_id FROM documents WHERE doc_id % 50 = 0")
def untracked_paths(spark, sf):
    """Present paths that the record lacks: made-up ones, and every entry that is left out of it here."""
    t = tracks(spark, sf)
    more = table(spark, sf, "documents").where("doc_id % 50 = 0").select(F.concat(F.lit("new/"), F.col("doc_id").cast("string")).alias("rel_path"))
    return integrity.untracked(t.where("mtime % 31 <> 3"), t.select("rel_path").union(more))


@query(f"WITH {VOL_SQL} SELECT arc_path, count(*) AS n_volumes FROM man GROUP BY arc_path HAVING count(*) > 1")
def entries_spanning_volumes(spark, sf):
    return volume_manifest(spark, sf).groupBy("arc_path").agg(F.count("*").alias("n_volumes")).where("n_volumes > 1")


@query(f"WITH {BLOCK_SQL} SELECT arc_path, kind, a AS g_start, z AS g_end FROM b")
def block_plan(spark, sf):
    return blk.block_plan(tracks(spark, sf)).select("arc_path", "kind", "g_start", "g_end")


@query(f"WITH {BLOCK_SQL} SELECT arc_path, kind, greatest(a, {RESUME}) AS g_start, z AS g_end, greatest(a, {RESUME}) - a AS skip FROM b WHERE z > {RESUME}")
def resume_clip(spark, sf):
    return blk.clip(blk.block_plan(tracks(spark, sf)), RESUME).select("arc_path", "kind", "g_start", "g_end", "skip")


@query(
    f"WITH {LAY_SQL}, r AS (SELECT * FROM t WHERE end_offset > {RESUME}) SELECT start_offset AS at, 0 AS rank, 'file_start' AS type, arc_path, start_offset, {RESUME} > start_offset AS resumed, NULL::BIGINT AS end_offset, NULL::BOOLEAN AS is_complete FROM r "
    f"UNION ALL SELECT start_offset, 1, 'file_end', arc_path, NULL, NULL, end_offset, size > 0 AND {RESUME} <= start_offset + 512 FROM r UNION ALL SELECT total, 2, 'tape_completed', NULL, NULL, NULL, NULL, NULL FROM tot"
)
def event_log(spark, sf):
    return blk.events(tracks(spark, sf), RESUME)


@query("SELECT doc_id, md5(encode(text)) AS md5sum FROM documents")
def content_md5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("md5sum"))


@query(f"WITH {BLOCK_SQL} SELECT kind, count(*) AS n, sum(z - a)::BIGINT AS bytes FROM b WHERE z > (SELECT total - 700 FROM tot) GROUP BY kind")
def footer_tail(spark, sf):
    t = tracks(spark, sf)
    return blk.clip(blk.block_plan(t), _total(t) - 700).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("g_end") - F.col("g_start") + F.col("skip")).alias("bytes"))


def _digest(spark, sf, cut: DataFrame, t: DataFrame, key: str) -> DataFrame:
    return content.ordered_digest(content.column_bytes(cut, t, _contents(spark, sf)), key)


@query(f"WITH {BYTES_SQL} SELECT 0::BIGINT AS stream, (length(hx) // 2)::BIGINT AS n_bytes, md5(unhex(hx)) AS md5 FROM x")
def stream_md5(spark, sf):
    t = tracks(spark, sf)
    return _digest(spark, sf, blk.clip(blk.block_plan(t), 0).withColumn("stream", F.lit(0)), t, "stream")


@query(f"WITH {BYTES_SQL} SELECT v AS vol_index, (length(substr(hx, v * {VOLUME} * 2 + 1, {VOLUME} * 2)) // 2)::BIGINT AS n_bytes, md5(unhex(substr(hx, v * {VOLUME} * 2 + 1, {VOLUME} * 2))) AS md5 FROM x, (SELECT unnest(range(0, (SELECT (total + {VOLUME} - 1) // {VOLUME} FROM tot))) AS v)")
def volume_md5(spark, sf):
    t = tracks(spark, sf)
    return _digest(spark, sf, blk.by_volume(blk.block_plan(t), VOLUME), t, "vol_index")


@query(f"WITH {BYTES_SQL} SELECT 0::BIGINT AS stream, (length(hx) // 2 - {RESUME})::BIGINT AS n_bytes, md5(unhex(substr(hx, {RESUME} * 2 + 1))) AS md5 FROM x")
def resume_suffix_md5(spark, sf):
    t = tracks(spark, sf)
    return _digest(spark, sf, blk.clip(blk.block_plan(t), RESUME).withColumn("stream", F.lit(0)), t, "stream")


@query(f"WITH {LAY_SQL}{_NOW_SQL} SELECT * FROM bad WHERE violation IS NOT NULL")
def verify_deep(spark, sf):
    t = tracks(spark, sf)
    return integrity.violations(t, _now(t))


@query(f"WITH {LAY_SQL}{_NOW_SQL} SELECT * FROM bad WHERE violation IS NOT NULL ORDER BY arc_path LIMIT 1")
def verify_first_violation(spark, sf):
    t = tracks(spark, sf)
    return integrity.first_violation(t, _now(t))


@query(f"WITH {LAY_SQL}{_NOW_SQL}, s AS (SELECT arc_path FROM t ORDER BY md5('7' || arc_path) LIMIT 15) SELECT bad.* FROM bad JOIN s USING (arc_path) WHERE violation IS NOT NULL")
def verify_sample(spark, sf):
    t = tracks(spark, sf)
    return integrity.violations(integrity.sample(t, seed=7), _now(t))


@query(f"WITH {LAY_SQL} SELECT (SELECT count(*) FROM t WHERE rel_path <> '' AND NOT contains(rel_path, '/')) AS recorded, (SELECT count(*) + 2 FROM t WHERE rel_path <> '' AND NOT contains(rel_path, '/')) AS present, 2::BIGINT AS untracked")
def root_structure_diff(spark, sf):
    t = tracks(spark, sf)
    more = spark.range(4).select(F.element_at(F.array(*map(F.lit, ("new1", "new2", ".DS_Store", ".archivolt"))), (F.col("id") + 1).cast("int")).alias("rel_path"))
    return integrity.root_difference(t, t.select("rel_path").union(more), DEFAULT_EXCLUDES)


@query(f"WITH {LAY_SQL}{_NOW_SQL} SELECT p AS byte, arc_path, violation FROM (SELECT unnest({list(_RESUMES)}) AS p) JOIN t ON start_offset <= p AND end_offset > p LEFT JOIN (SELECT * FROM bad WHERE violation IS NOT NULL) USING (arc_path)")
def resume_point_check(spark, sf):
    t = tracks(spark, sf)
    found = lay.tracks_at(t, _RESUMES)
    bad = integrity.violations(found.drop("byte").dropDuplicates(["arc_path"]), _now(t))
    return found.select("byte", "arc_path").join(bad, "arc_path", "left").select("byte", "arc_path", "violation")


@query(f"WITH {LAY_SQL}{_NOW_SQL} SELECT p AS byte, arc_path, violation FROM (SELECT unnest(range(0, (SELECT total FROM tot), {VOLUME})) AS p) JOIN t ON start_offset <= p AND end_offset > p LEFT JOIN (SELECT * FROM bad WHERE violation IS NOT NULL) USING (arc_path)")
def resume_volume_check(spark, sf):
    """As resume_point_check, at the first byte of every volume up to the stream's end."""
    t = tracks(spark, sf)
    found = lay.grid_points(t, VOLUME)
    bad = integrity.violations(found.drop("byte").dropDuplicates(["arc_path"]), _now(t))
    return found.select("byte", "arc_path").join(bad, "arc_path", "left").select("byte", "arc_path", "violation")


@query(f"WITH {INV_SQL}, c AS (SELECT arc_path AS a, size AS s, mtime AS m, md5(arc_path) AS h FROM inv WHERE mtime % 3 <> 0) SELECT arc_path, CASE WHEN NOT is_dir AND NOT is_symlink THEN h END AS md5sum, NOT is_dir AND NOT is_symlink AND h IS NOT NULL AS hit FROM inv LEFT JOIN c ON arc_path = a AND size = s AND mtime = m")
def hash_cache_probe(spark, sf):
    i = corpus(spark, sf)
    cache = i.where(F.col("mtime") % 3 != 0).select("arc_path", "size", "mtime", F.md5(F.col("arc_path").cast("binary")).alias("md5sum"))
    return hash_cache.probe(i, cache).select("arc_path", "md5sum", "hit")


@query(
    "WITH l AS (SELECT 'cache_' || c_custkey || '.db' AS name, c_custkey % 17 AS mtime, c_custkey * 4000 AS size FROM customer), w AS (SELECT *, row_number() OVER (ORDER BY mtime, name) AS rn, coalesce(sum(size) OVER (ORDER BY mtime, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, count(*) OVER () AS n, sum(size) OVER () AS total FROM l) "
    "SELECT name, mtime, size FROM w WHERE n - (rn - 1) > 10 OR total - freed > 1073741824"
)
def cache_evictions(spark, sf):
    c = F.col("c_custkey")
    listing = table(spark, sf, "customer").select(F.concat(F.lit("cache_"), c.cast("string"), F.lit(".db")).alias("name"), (c % 17).alias("mtime"), (c * 4000).alias("size"))
    return hash_cache.evictions(listing)


@query("SELECT page_id, 'cache_' || sha1(url) || '.db' AS name FROM pages")
def cache_db_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", en.cache_name(F.col("url")).alias("name"))
