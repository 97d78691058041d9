"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c. A random rotation spreads a vector's energy evenly; the rotated vector is split into
blocks of few dimensions, and by the pigeonhole principle two near vectors are, in some block, within that block's share of the squared distance (in proportion to its
dimensions). So each block is range-joined: a grid along its first coordinate, with cells as wide as the block's radius, shows a vector to its own cell
and the next one; cells with many vectors are split along the block's further coordinates. Only the block's few numbers are dealt to the cells. Pairs within
the block's budget are candidates; their full vectors are joined, and each pair is verified by its exact cosine in the first block that finds it.

A cell that no coordinate splits is cut into tiles of bounded size, so no task gets an unbounded group. A tile whose candidates are many (a cluster of
near copies) does not list them: its full vectors are dealt to it, and it returns counts of links for each vector and a spanning set of links, never all
pairs. Equal vectors are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, lookup, materialize, slices

BLOCK_DIMS = 8
#: Home vectors of a cell beyond which it is split along a further coordinate, and vectors of one side of a tile.
SPLIT, TILE = 2048, 2048
#: Candidates for each vector of a tile beyond which they are counted in the tile and not listed.
LISTED = 16
#: A coordinate splits a cell where no place along it holds more than this share of its home vectors.
SHARE = 1 / 3
_SLACK = 1e-9


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7919).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int) -> list[slice]:
    return [slice(i, min(i + BLOCK_DIMS, dims)) for i in range(0, dims, BLOCK_DIMS)]


def _budget(b: slice, dims: int, least: float) -> float:
    return (2 - 2 * least) * (b.stop - b.start) / dims + _SLACK


def _loose(budget: float) -> float:
    """A budget for coordinates in single precision: what is within budget in double precision is within this one."""
    return budget * (1 + 1e-5) + 1e-6


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _turned(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)) @ rotation(v.shape[1]).T


def _place(least: float):
    """(cid, label, embedding) -> for each block its coordinates and, by the first of them, its home cell and the next cell, which it is shown to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for dims in np.unique(n).tolist():
                some = batch.filter(pa.array(n == dims))
                w = _turned(_matrix(some.column(2), dims))
                for k, b in enumerate(blocks_of(dims)):
                    p = w[:, b].astype(np.float32)
                    r = float(np.sqrt(_loose(_budget(b, dims, least))))
                    at = np.floor(p[:, 0] / r).astype(np.int32)
                    flat = pa.array(p.ravel())
                    ends = pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32))
                    for step in (0, 1):
                        cell = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32)), pa.array(at + step))
                        one = lambda x, t: pa.array(np.full(len(at), x), t)  # noqa: E731, B023
                        yield pa.RecordBatch.from_arrays([some.column(1), one(dims, pa.int32()), one(k, pa.int32()), cell, some.column(0), one(step == 0, pa.bool_()), one(r, pa.float64()), pa.ListArray.from_arrays(ends, flat)], names=["label", "dims", "block", "cell", "cid", "home", "r", "p"])

    return run


_CELL = ["label", "dims", "block", "cell"]
_TILE = [*_CELL, "sg", "hg"]


def _screen(least: float):
    """One tile: rows (side 0: shown, 1: home) with the block's coordinates -> candidates (a shown, b home), or one row without them where they are many."""

    def run(key: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        dims, block = key[1].as_py(), key[2].as_py()
        budget = _loose(_budget(blocks_of(dims)[block], dims, least))
        side, cid, own = tab["side"].to_numpy(), tab["cid"].to_numpy(), tab["own"].to_numpy(zero_copy_only=False)
        p = _matrix(tab["p"].combine_chunks(), blocks_of(dims)[block].stop - blocks_of(dims)[block].start).astype(np.float64)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        most, found, total = LISTED * (len(a) + len(b)), [], 0
        square = (p * p).sum(1)
        for at in range(0, len(a), 512):  # a part of the shown side at a time
            x = a[at : at + 512]
            near = square[x][:, None] + square[b][None] - 2 * p[x] @ p[b].T <= budget
            i, j = np.nonzero(near)
            ca, cb = cid[x[i]], cid[b[j]]
            ok = (ca != cb) & (~(own[x[i]] & own[b[j]]) | (ca < cb))  # in a vector's own cell, each pair once
            found.append((ca[ok], cb[ok]))
            total += int(ok.sum())
            if total > most:
                return pa.table({**{n: pa.array([k.as_py()], t) for n, k, t in zip(_TILE, key, (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32()), strict=True)}, "a": pa.array([None], pa.int64()), "b": pa.array([None], pa.int64())})
        ca, cb = (np.concatenate([np.empty(0, np.int64), *(f[s] for f in found)]) for s in (0, 1))
        none = lambda t: pa.nulls(len(ca), t)
        return pa.table({"label": none(pa.int32()), "dims": pa.array(np.full(len(ca), dims), pa.int32()), "block": pa.array(np.full(len(ca), block), pa.int32()), "cell": none(pa.list_(pa.int32())), "sg": none(pa.int32()), "hg": none(pa.int32()), "a": pa.array(ca), "b": pa.array(cb)})

    return run


def _first_blocks(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """The first block that finds each pair of rotated rows; the number of blocks where none does."""
    dims = x.shape[1]
    blocks = blocks_of(dims)
    near = np.stack([((x[:, s] - y[:, s]) ** 2).sum(1) <= _budget(s, dims, least) for s in blocks])
    return np.where(near.any(0), near.argmax(0), len(blocks))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def _verify_pairs(least: float):
    """(block, a, b, ea, eb) -> the pairs whose cosine is enough and that no earlier block finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = pa.compute.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
            for dims in np.unique(n).tolist():
                some = batch.filter(pa.array(n == dims))
                x, y = (_matrix(some.column(c), dims).astype(np.float64) for c in (3, 4))
                ok = (_first_blocks(_turned(x), _turned(y), least) == some.column(0).to_numpy()) & (_cosines(x, y) >= least)
                yield pa.RecordBatch.from_arrays([some.column(1).filter(pa.array(ok)), some.column(2).filter(pa.array(ok))], names=["a", "b"])

    return run


def _count_tile(least: float):
    """One tile with full vectors: links of shown with home vectors that no earlier block finds, as counts by vector and a spanning set of links."""

    def run(key: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        dims, block = key[1].as_py(), key[2].as_py()
        side, cid, weight = (tab[c].to_numpy() for c in ("side", "cid", "weight"))
        own = tab["own"].to_numpy(zero_copy_only=False)
        v = _matrix(tab["embedding"].combine_chunks(), dims).astype(np.float64)
        w = _turned(v)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        own_block = blocks_of(dims)[block]
        budget = _loose(_budget(own_block, dims, least))
        n, root, links = np.zeros(len(cid), np.int64), list(range(len(cid))), []

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for at in range(0, len(a), 128):
            x = a[at : at + 128]
            p, q = w[x][:, own_block], w[b][:, own_block]
            near = (p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * p @ q.T <= budget
            i, j = np.nonzero(near)
            i, j = x[i], b[j]
            ok = (cid[i] != cid[j]) & (~(own[i] & own[j]) | (cid[i] < cid[j]))
            i, j = i[ok], j[ok]
            for lo in range(0, len(i), 1 << 15):
                u, z = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
                ok = (_cosines(v[u], v[z]) >= least) & (_first_blocks(w[u], w[z], least) == block)
                u, z = u[ok], z[ok]
                np.add.at(n, u, weight[z])
                np.add.at(n, z, weight[u])
                for p, q in zip(u.tolist(), z.tolist(), strict=True):
                    p0, q0 = find(p), find(q)
                    if p0 != q0:
                        root[p0] = q0
                        links.append((int(cid[p]), int(cid[q])))
        got = np.flatnonzero(n)
        ids, counts = cid[got].tolist(), n[got].tolist()
        return pa.table({"a": pa.array(ids + [x for x, _ in links], pa.int64()), "b": pa.array([None] * len(ids) + [y for _, y in links], pa.int64()), "n": pa.array(counts + [None] * len(links), pa.int64())})

    return run


def _tiles(placed: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """placed with tile groups: each shown group of a cell meets each of its home groups."""
    sizes = sizes.where("n_home > 0 and n_shown > 1").select(*_CELL, F.ceil(F.col("n_home") / TILE).cast("int").alias("h"), F.ceil(F.col("n_shown") / TILE).cast("int").alias("s"))
    held = placed.join(sizes, _CELL)
    pick = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shown = held.select(*_CELL, pick("s").alias("sg"), every("h").alias("hg"), F.lit(0).alias("side"), "cid", F.col("home").alias("own"), "p")
    home = held.where("home").select(*_CELL, every("s").alias("sg"), pick("h").alias("hg"), F.lit(1).alias("side"), "cid", F.lit(True).alias("own"), "p")
    return scratch.write(shown.union(home), "tiles")


def _sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy(*_CELL).agg(F.sum(F.col("home").cast("long")).alias("n_home"), F.count("*").alias("n_shown"))


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept.

    Vectors of one label (and one length) link where their cosine in double precision is at least `least`. Null labels, null vectors, empty ones, zero ones and ones with null or
    non-finite components link with nothing, as do rows without vec_id. Repeated rows, and rows that share a vec_id, are vectors of their own: equal
    vectors link with each other. Each row of the table gets one row. Other columns are ignored. An empty table gives an empty result.
    """
    with Scratch(vectors.sparkSession, "near-vectors") as scratch:
        return materialize(_near_vectors(vectors, least, scratch), "near-vectors")


def _near_vectors(vectors: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    write = scratch.write
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    single = F.col("embedding").cast("array<float>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), single.alias("embedding"), good.alias("good"))
    # a class is all equal vectors of a label, by 128 bits of hashes; each gets a number when it is written
    keyed = rows.withColumns({"k0": F.xxhash64("embedding"), "k1": F.xxhash64(F.lit(1), F.reverse("embedding"))})
    equal = ["label", "k0", "k1"]
    grouped = keyed.where("good").groupBy(*equal).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.min("embedding").alias("embedding"))
    classes = write(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    placed = write(classes.select("cid", "label", "embedding").mapInArrow(_place(least), "label int, dims int, block int, cell array<int>, cid long, home boolean, r double, p array<float>"), "cells")
    sizes = write(_sizes(placed), "cell-sizes")
    while True:
        hot = sizes.where((F.col("n_home") > SPLIT) & (F.col("n_shown") > 1)).select(*_CELL)
        along = placed.where("home").join(hot, _CELL).select(*_CELL, "r", F.posexplode("p").alias("c", "x")).withColumn("z", F.floor(F.col("x") / F.col("r")))
        tops = along.groupBy(*_CELL, "c", "z").count().groupBy(*_CELL, "c").agg(F.max("count").alias("top"), F.sum("count").alias("all"))
        # each cell by the coordinate that spreads it most; one that it was split by before spreads it no more
        by = write(tops.groupBy(*_CELL).agg(F.min_by("c", F.struct("top", "c")).alias("c"), F.min("top").alias("top"), F.max("all").alias("all")).where(F.col("top") <= F.col("all") * SHARE).select(*_CELL, "c"), "split-cells")
        if not by.limit(1).count():
            break
        # a home vector goes to its place and the next one, a shown one to its place and both neighbours; only the copy in a home vector's own place stays home
        some = placed.join(by, _CELL).withColumn("z", F.floor(F.get("p", F.col("c")) / F.col("r")).cast("int"))
        to = F.when(F.col("home"), F.array("z", F.col("z") + 1)).otherwise(F.array(F.col("z") - 1, "z", F.col("z") + 1))
        split = some.withColumn("to", F.explode(to)).select("label", "dims", "block", F.concat("cell", F.array("c", "to")).alias("cell"), "cid", (F.col("home") & (F.col("to") == F.col("z"))).alias("home"), "r", "p")
        placed = write(placed.join(by, _CELL, "left_anti").unionByName(split), "cells")
        sizes = write(_sizes(placed), "cell-sizes")
    tiles = _tiles(placed, sizes, scratch)
    found = write(tiles.groupBy(*_TILE).applyInArrow(_screen(least), "label int, dims int, block int, cell array<int>, sg int, hg int, a long, b long"), "candidates")
    full = classes.select("cid", "embedding")
    pairs = found.where("a is not null").select("block", "a", "b")
    for side in "ab":
        pairs = pairs.join(full.select(F.col("cid").alias(side), F.col("embedding").alias(f"e{side}")), side)
    links = write(pairs.select("block", "a", "b", "ea", "eb").mapInArrow(_verify_pairs(least), "a long, b long"), "links")
    dense = found.where("a is null").select(*_TILE)
    whole = write(tiles.drop("p").join(dense, _TILE).join(classes.select("cid", "weight", "embedding"), "cid"), "dense-tiles")
    counted = write(whole.groupBy(*_TILE).applyInArrow(_count_tile(least), "a long, b long, n long"), "dense-links")
    weights = classes.select("cid", "weight")
    both = write(links.union(links.select("b", "a")).toDF("cid", "other"), "both-ways")
    sums = lookup(both, ["other"], weights.withColumnsRenamed({"cid": "other", "weight": "n"})).select("cid", "n").union(counted.where("b is null").select(F.col("a").alias("cid"), "n"))
    sums = write(sums.groupBy("cid").agg(F.sum("n").alias("linked")), "link-counts")
    comps = connected_components(links.union(counted.where("b is not null").select("a", "b")), scratch)
    per = classes.select("cid", *equal, "rep", "weight").join(sums, "cid", "left").join(comps.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    per = write(per.select("comp", *equal, "rep", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "classes-linked")
    per = write(lookup(per, ["comp"], per.groupBy("comp").agg(F.min("rep").alias("component_id"))).select(*equal, "n_links", "component_id"), "classes-done")
    out = lookup(write(keyed.where("good").select("vec_id", *equal), "vectors"), equal, per).select("vec_id", "n_links", "component_id")  # classes of many copies are hot
    rest = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
