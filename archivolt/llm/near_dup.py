"""Near-duplicate documents by b-bit MinHash.

Every document is hashed by PERMS permutations. The full minima form BANDS band keys for candidate generation; then
only the low BITS bits of each minimum are retained, packed as bit planes in 64-bit words, and a pair's similarity is
estimated from bit counts, corrected for the chance that unequal minima agree in their low bits. A parity sketch of the set, a bound on the symmetric difference by one more bit
count, spares most exact checks. What survives is confirmed exactly on the full shingle sets.

Groups of copies never become all pairs. Documents with equal sets are one class from the start. Each
document is first compared with one smallest id of its band buckets, then, where a bucket still holds several components of confirmed
links, with that bucket's smallest id; last, only members of different components in one bucket are compared. So every pair of bucket-mates is
either in one component or has been checked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, lookup, materialize, maybe_broadcast, slices

#: 42 bands of 6 rows miss a pair of similarity 0.8 with probability 3e-6, one of 0.9 with 1e-14.
BANDS, ROWS = 42, 6
PERMS, BITS = 256, 2
PLANES = PERMS // 64 * BITS
#: Bits of a set's parity sketch: the count of unequal bits of two sketches is at most, and nearly, the sets' symmetric difference.
PARITY = 2048
#: Standard deviations below the threshold at which an estimate drops a pair.
SIGMAS = 6.0
_SEEDS = np.random.default_rng(20240131).integers(0, 2**32, (2, PERMS), dtype=np.uint64).astype(np.uint32)
_SEEDS[1] |= 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BLOCK = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; fewer words than `words` make one shingle."""
    import xxhash

    if text is None:
        return np.empty(0, np.uint64)
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    toks = data.lower().split()  # bytes: lowers A-Z and splits at 0x20 and 0x09-0x0D only
    if not toks:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, toks), np.uint64, len(toks))
    k = min(words, len(h))
    n = len(h) - k + 1
    x = np.full(n, k, np.uint64)
    for i in range(k):
        x = _mix(x + h[i : i + n])
    return np.unique(x)


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """PERMS x len(sets) minima of non-empty sets."""
    out = np.empty((PERMS, len(sets)), np.uint32)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= _BLOCK):
            size += len(sets[j])
            j += 1
        x = (np.concatenate(sets[i:j]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[i : j - 1])])
        h = np.empty_like(x)
        for p in range(PERMS):
            np.bitwise_xor(x, _SEEDS[0, p], out=h)
            np.multiply(h, _SEEDS[1, p], out=h)
            np.minimum.reduceat(h, starts, out=out[p, i:j])
        i = j
    return out


def signature(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(len(sets) x BANDS band keys, len(sets) x PLANES packed low bits), both int64, of non-empty sets."""
    m = _minima(sets)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        k = np.full(len(sets), b + 1, np.uint64)
        for r in range(ROWS):
            k = _mix(k + m[b * ROWS + r])
        keys[:, b] = k
    v = m ^ (m >> np.uint32(15))
    v *= np.uint32(0x2C1B3C6D)
    v ^= v >> np.uint32(13)
    bits = np.stack([(v >> np.uint32(b)) & np.uint32(1) for b in range(BITS)]).astype(np.uint8)
    packed = np.packbits(bits.transpose(2, 0, 1), axis=2).reshape(len(sets), -1).view(">u8").astype(np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


def parity_sketch(x: np.ndarray) -> np.ndarray:
    """PARITY / 64 words (int64); bit i is the parity of the number of hashes with low bits i."""
    odd = (np.bincount((x & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            keys, sig = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), PLANES + PARITY // 64), np.int64)
            some = [i for i, s in enumerate(sets) if len(s)]
            if some:
                keys[some], sig[some, :PLANES] = signature([sets[i] for i in some])
                for i in some:
                    sig[i, PLANES:] = parity_sketch(sets[i])
            d = np.frombuffer(b"".join(hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            more = batch.columns[2:]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), lists(keys), lists(sig), *more], names=["id", "n", "d0", "d1", "bands", "sig", "key"][: 6 + len(more)])

    return run


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last = object(), None
        for batch in slices(batches, 100):
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for i in range(len(a)):
                if a[i] != last_id:
                    last_id, last = a[i], shingle_set(ta[i], words)
                x = shingle_set(tb[i], words)
                both = len(np.intersect1d(last, x, assume_unique=True))
                if 100 * both >= percent * (len(last) + len(x) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return run


def _alike(na: Column, nb: Column, sa: Column, sb: Column, percent: int) -> Column:
    """Whether set sizes, the bit-count estimate of two signatures, and their parity sketches allow the similarity."""
    least = percent / 100
    c = 1 / 2**BITS
    p = c + (1 - c) * least  # the share of equal slots at that similarity, chance agreement included
    floor = p - SIGMAS * (p * (1 - p) / PERMS) ** 0.5
    per = PERMS // 64
    differ = []
    for w in range(per):  # a slot matches where all its bit planes do
        diff = [sa[b * per + w].bitwiseXOR(sb[b * per + w]) for b in range(BITS)]
        any_diff = diff[0]
        for x in diff[1:]:
            any_diff = any_diff.bitwiseOR(x)
        differ.append(F.bit_count(any_diff))
    # a function of arrays: with all words written out, joins that compare many pairs took 2.6 times as long
    ham = F.aggregate(F.zip_with(F.slice(sa, PLANES + 1, PARITY // 64), F.slice(sb, PLANES + 1, PARITY // 64), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    most = (na + nb) * (100 - percent) / (100 + percent)  # symmetric difference of the sets
    mean, sd = PARITY / 2 * (1 - F.exp(-2 * most / PARITY)), F.sqrt(PARITY / 4 * (1 - F.exp(-4 * most / PARITY)))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (PERMS - sum(differ[1:], differ[0]) >= PERMS * floor) & (ham <= F.least(most, mean + SIGMAS * sd))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, text_key: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, and with text_key its text's xxhash64.

    Links documents whose shingle sets have 100 * intersection >= percent * union. Words are split at ASCII white
    space after lower-casing A-Z. A text of fewer than `words` words is one shingle; null, empty or blank texts have none and link with
    nothing. Documents with equal sets (by a 128-bit cryptographic digest of the whole set) and repeated rows are one class; rows that share an id are
    taken as one document for links, and each row stays in the result. A row without id links with nothing: component_id is null and kept false.
    Other columns are ignored, so their names cannot clash. An empty table gives an empty result.
    """
    with Scratch(docs.sparkSession, "near-dup") as scratch:
        return materialize(_near_duplicates(docs, scratch, id_col, text_col, words, percent, text_key), "near-duplicates")


def _near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, words: int, percent: int, text_key: bool) -> DataFrame:
    write = scratch.write
    key = [F.xxhash64(text_col).alias("key")] if text_key else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("t"), *key)
    signed = write(rows.mapInArrow(_sign(words), "id long, n long, d0 long, d1 long, bands array<long>, sig array<long>" + (", key long" if text_key else "")), "signed")
    reps = write(signed.where("n > 0 and id is not null").groupBy("d0", "d1").agg(F.min(F.struct("id", "n", "bands", "sig")).alias("r")).select("d0", "d1", "r.*"), "classes")
    banded = reps.select("id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).where("pivot < top").select("key", "pivot")
    members = write(banded.join(shared, "key"), "members")
    sigs = reps.select("id", "n", "sig")

    def screened(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) that signatures allow; a is a pivot, which many rows may share."""
        own = lookup(write(pairs, "tried"), ["a"], sigs.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")))
        both = own.join(sigs.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
        return both.where(_alike(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"), percent)).select("a", "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = write(pairs.distinct(), "pairs")
        ids = write(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
        held = write(rows.join(maybe_broadcast(ids, 16 * ids.count()), "id", "left_semi").select("id", "t"), "texts")
        near = pairs.join(held.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b").join(held.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
        return write(near.select("a", "b", "ta", "tb").mapInArrow(_confirm(words, percent), "a long, b long").distinct(), "links")

    def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
        """comps (id, comp) after links, by components of components."""
        if not links.limit(1).count():
            return comps
        for side in "ab":
            links = write(lookup(links, [side], comps.select(F.col("id").alias(side), F.col("comp").alias(f"c{side}"))), "placed-links")
        lower = connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch)
        return write(lookup(comps, ["comp"], lower.select(F.col("id").alias("comp"), F.col("comp").alias("low"))).select("id", F.coalesce("low", "comp").alias("comp")), "comps")

    def unsettled(comps: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components; base is the pivot's."""
        placed = members.join(comps, "id")
        mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("comp", "id").alias("base")).where("lo < hi").select("key", "base")
        return placed.join(mixed, "key")

    # first each document with the smallest pivot of all its buckets, then with the pivots of the buckets that are still mixed, last all members of different components
    comps = write(members.select("id").distinct().withColumn("comp", F.col("id")), "comps")
    comps = merged(comps, confirmed(screened(members.where("id <> pivot").groupBy(F.col("id").alias("b")).agg(F.min("pivot").alias("a")))))
    comps = merged(comps, confirmed(screened(unsettled(comps).where("comp <> base").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())))
    left = write(unsettled(comps).join(sigs, "id").select("key", "id", "pivot", "comp", "base", "n", "sig"), "unsettled")
    out = left.where("comp <> base").select(F.col("key").alias("ok"), F.col("id").alias("o"), F.col("comp").alias("oc"), F.col("n").alias("on"), F.col("sig").alias("os"))
    cross = left.join(out, (F.col("key") == F.col("ok")) & F.expr("id <> pivot and comp <> oc and (comp = base or id < o)") & _alike(F.col("n"), F.col("on"), F.col("sig"), F.col("os"), percent))
    comps = merged(comps, confirmed(cross.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b"))))
    home = write(reps.select("d0", "d1", "id").join(comps, "id", "left").select("d0", "d1", F.coalesce("comp", "id").alias("comp")), "homes")
    own = ["key"] if text_key else []
    found = lookup(signed.select("id", "n", "d0", "d1", *own), ["d0", "d1"], home)  # the classes of many copies are hot
    comp = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("id")))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(False)).alias("kept"), *(F.col(x).alias("text_key") for x in own))
