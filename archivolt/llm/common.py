"""Helpers that the operators share: reading, tables in the shared folder, size-checked broadcast, look-ups of hot keys, components, fitting samples."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table is broadcast; above it Spark shuffles.
BROADCAST_BYTES = 32 << 20
#: A key is hot if it has more than this share of the rows; so there are at most as many hot keys as its inverse.
HOT_SHARE = 1e-4
#: Rows that a key may have in any case.
COOL_ROWS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary one, in local mode only."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("archivolt.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="archivolt-")
        spark.conf.set("archivolt.shared.dir", where)
    return where.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the application ends."""
    home = f"{shared_dir(spark)}/archivolt/{spark.sparkContext.applicationId}"
    p, fs = _path(spark, home)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{home}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage is cut, and a lost executor costs no recomputation."""
    path = path or new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables that an operator writes on its way. They go when it ends; its result is a table of its own."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.home = spark, new_path(spark, tag)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        p, fs = _path(self.spark, self.home)
        fs.delete(p, True)

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        return materialize(df, tag, f"{self.home}/{tag}-{uuid.uuid4().hex}")


def give_back() -> None:
    """Return freed memory to the system. Spark uses a worker again for later stages, which would else start from its highest use so far."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches cut to `rows` rows. Spark bounds a batch's bytes (64 MB by default), this what is unpacked at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        give_back()


def by_slices(values: pa.Array, work, kind: pa.DataType, rows: int = 1000) -> pa.Array:
    """work(list of values) -> list of results, `rows` values at a time, so that only these are Python objects at once."""
    parts = [pa.array(work(values.slice(at, rows).to_pylist()), kind) for at in range(0, len(values), rows)]
    whole = pa.concat_arrays(parts) if parts else pa.array([], kind)
    del parts
    give_back()
    return whole


def maybe_broadcast(df: DataFrame, size: int) -> DataFrame:
    """Broadcast df only where its counted bytes are within the limit; else leave the join to Spark."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def hot_keys(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The hot keys of df, which has n rows; at most 1 / HOT_SHARE of them. Counts combine on the map side."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max(COOL_ROWS, int(n * HOT_SHARE))).select(*keys)


def lookup(df: DataFrame, keys: list[str], values: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """df left-joined with values, which has each key once. Rows of hot keys never meet in one task: their few values are broadcast to them.

    df is read several times, so it should be a written table. Its keys, of fixed or small width, may be null; those find nothing.
    """
    hot = hot_keys(df, keys, df.count()) if hot is None else hot
    known = hot.join(values, keys, "left").select(*(F.col(k).alias(f"_hot_{k}") for k in keys), *(c for c in values.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
    known = F.broadcast(known)  # at most 1 / HOT_SHARE rows
    held = df.join(known, same).drop(*(f"_hot_{k}" for k in keys))
    rest = df.join(F.broadcast(known.select(*(f"_hot_{k}" for k in keys))), same, "left_anti").join(values, keys, "left")
    return held.unionByName(rest)


def packed(docs: DataFrame) -> DataFrame:
    """docs as d (doc_id), k (a hash of the text) and the whole row as one struct `row`, so that no other name of docs can clash."""
    return docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("k"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of docs from `row`, with another text and its length in n_chars if text is given."""
    new = {} if text is None else {"text": text, "n_chars": F.char_length(text).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def keyed(found: DataFrame) -> DataFrame:
    """found (d, k, ...) as the right side of a join by `same`."""
    return found.withColumnsRenamed({"d": "rd", "k": "rk"})


def same(left: DataFrame, right: DataFrame) -> Column:
    """The same id, null or not, and the same text."""
    return left["d"].eqNullSafe(right["rd"]) & (left["k"] == right["rk"])


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b) -> (id, comp): every id of an edge with the smallest id that it reaches.

    Each round a node takes the smallest label of its neighbours, so does the node that its label names, and every node takes its label's label; so trees
    of labels grow together and long chains need few rounds. A round is look-ups and map-side combined minima; hubs and large components are hot keys
    of `lookup`. Each round's labels are written, which cuts their lineage; nothing goes to the driver but counts.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.write(both.where("a <> b").distinct(), "edges")
    n = both.count()
    lab = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), "labels")
    if not n:
        return lab
    hubs = scratch.write(hot_keys(both, ["b"], n), "hubs")
    nodes = lab.count()
    while True:
        seen = lookup(both, ["b"], lab.select(F.col("id").alias("b"), "comp"), hubs).groupBy("a").agg(F.min("comp").alias("m"))
        near = scratch.write(lab.join(seen, F.col("id") == F.col("a")).select("id", "comp", "m"), "seen")
        roots = near.where("m < comp").groupBy(F.col("comp").alias("root")).agg(F.min("m").alias("r"))
        hooked = scratch.write(near.join(roots, F.col("id") == F.col("root"), "left").select("id", F.col("comp").alias("old"), F.least("comp", "m", "r").alias("comp")), "hooked")
        if not hooked.where("comp <> old").limit(1).count():
            return lab
        up = lookup(hooked, ["comp"], hooked.select(F.col("id").alias("comp"), F.col("comp").alias("up")), hot_keys(hooked, ["comp"], nodes))
        lab = scratch.write(up.select("id", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")


def first_keys(rows: DataFrame, limit: int) -> dict:
    """{g: keys} of rows (g, d, k): of each group the `limit` different (d, k) that are first by a hash; the same on every run and partitioning.

    Only keys below a bound of the hash are sent to the driver, a few times `limit` for each group; the bound rises where that gives too few. Groups must
    be few.
    """
    rows = rows.where("g is not null").withColumn("h", F.xxhash64("d", "k"))
    share = {r["g"]: min(1.0, 4 * limit / r["n"]) for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    out: dict = {}
    while share:
        tops = F.create_map(*(F.lit(x) for g, s in share.items() for x in (g, min(2**63 - 1, int(-(2**63) + s * 2**64)))))
        found: dict = {}
        for r in rows.where(F.col("h") <= tops[F.col("g")]).groupBy("g", "h", "d", "k").count().collect():
            found.setdefault(r["g"], []).append((r["h"], r["d"], r["k"]))
        for g, s in list(share.items()):
            if len(found.get(g, ())) >= limit or s == 1.0:
                out[g] = [(d, k) for _, d, k in sorted(found.get(g, ()))[:limit]]
                del share[g]
            else:
                share[g] = min(1.0, 4 * s)
    return out


def fitting_texts(docs: DataFrame, group: Column, limit: int, where: Column | None = None) -> dict:
    """{group: texts} of at most `limit` different rows (doc_id, text) of each group, as first_keys picks them.

    Null groups, ids and texts are left out, as is what `where` excludes; equal rows give their text once.
    """
    def rows(of: DataFrame) -> DataFrame:
        return of.select(group.alias("g"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("k"), F.col("text").alias("t")).where("d is not null and t is not null")

    keys = first_keys(rows(docs if where is None else docs.where(where)).select("g", "d", "k"), limit)
    if not keys:
        return {}
    some = docs.sparkSession.createDataFrame([(d, k) for own in keys.values() for d, k in own], "d long, k long").distinct()  # `limit` for each group at most
    found = rows(docs).select("d", "k", "t").join(F.broadcast(some), ["d", "k"]).groupBy("d", "k").agg(F.min("t").alias("t"))
    texts = {(r["d"], r["k"]): r["t"] for r in found.toLocalIterator()}
    return {g: [texts[x] for x in own] for g, own in keys.items()}
