"""Token-id files in a Simple-8b word-aligned coding.

A word is 64 bits: a selector in the top four and a count of ids in the other sixty, by SELECTORS. Selector 0 is an escape: the next word is one raw id of
60 bits or more. A shard holds a contiguous range of (doc_id, hash of the text) in ascending order, cut into blocks of whole documents; each block row
has its words, the ids before it in its shard, and per document the id count, so that a reader can seek, and decodes a block by table look-ups
on whole arrays. Shards are Parquet tables of block rows: Spark's commit protocol makes a rewritten or lost task harmless.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, slices

#: (ids in a word, bits of each), for selectors 1 to 14.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNT = np.array([0, *(n for n, _ in SELECTORS)])
#: Ids of a block, unless one document has more.
BLOCK_IDS = 1 << 16
#: Bytes of the table for a shard, and most shards; what Spark estimates where it can't tell is at least UNKNOWN.
SHARD_BYTES, MOST_SHARDS, UNKNOWN = 16 << 20, 10_000, 1 << 60


def pack(ids: np.ndarray) -> np.ndarray:
    """Words (uint64) of non-negative 64-bit ids: at each place the selector that takes most ids, all of which must exist."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    step, sel = np.zeros(n + 1, np.uint8), np.zeros(n + 1, np.uint8)
    most = int(ids.max())
    for s in range(len(SELECTORS), 0, -1):
        count, bits = SELECTORS[s - 1]
        if n < count:
            break
        if not most >> bits:
            step[: n - count + 1], sel[: n - count + 1] = count, s
            continue
        good = np.flatnonzero(ids < np.uint64(1 << bits))
        if len(good) < count:
            break  # nor is there a run for fewer bits
        # good[i + count - 1] lies count - 1 beyond good[i] just where a run of count ids fits
        at = good[: len(good) - count + 1][good[count - 1 :] - good[: len(good) - count + 1] == count - 1]
        step[at], sel[at] = count, s
    step[:n][step[:n] == 0] = 1  # escapes
    hops, i, jump = [], 0, step.tobytes()
    while i < n:
        hops.append(i)
        i += jump[i]
    start = np.array(hops)
    kind = sel[start]
    words = kind.astype(np.uint64) << np.uint64(60)
    for s in np.unique(kind):
        if not s:
            continue
        count, bits = SELECTORS[int(s) - 1]
        rows = np.flatnonzero(kind == s)
        for j in range(count):
            words[rows] |= ids[start[rows] + j] << np.uint64(j * bits)
    if (raw := np.flatnonzero(kind == 0)).size:
        words = np.insert(words, raw + 1, ids[start[raw]])
    return words


def escapes(words: np.ndarray, has: bool) -> np.ndarray:
    """Places of escape words; a raw word after one is not a selector."""
    if not has:
        return np.empty(0, np.int64)
    out, skip = [], -1
    for i in np.flatnonzero(words >> np.uint64(60) == 0).tolist():
        if i != skip:
            out.append(i)
            skip = i + 1
    return np.array(out, np.int64)


def unpack(words: np.ndarray, has_escapes: bool = True) -> np.ndarray:
    """Ids (uint64) of words, by whole arrays: counts by selector give each word's place."""
    if not len(words):
        return np.empty(0, np.uint64)
    esc = escapes(words, has_escapes)
    raw = words[esc + 1]
    live = np.ones(len(words), bool)
    live[esc + 1] = False
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = np.where(live, np.where(sel == 0, 1, _COUNT[np.minimum(sel, 14)]), 0)
    ends = np.cumsum(count)
    out = np.empty(int(ends[-1]), np.uint64)
    first = ends - count
    for s in np.unique(sel[live]):
        if not s:
            continue
        n, bits = SELECTORS[int(s) - 1]
        rows = np.flatnonzero(live & (sel == s))
        mask = np.uint64((1 << bits) - 1)
        for j in range(n):
            out[first[rows] + j] = (words[rows] >> np.uint64(j * bits)) & mask
    out[first[esc]] = raw
    return out


#: Letters of ASCII and Latin-1 as the lower-casing of A-Z leaves them: a word of these is one piece, whatever the normalizer does.
_LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
_WORD = "^[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: ASCII signs: a run of them after such a word is a piece of its own.
_SIGNS = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))
#: Words encoded as one run, and runs in one call.
RUN, RUNS = 256, 16
#: Bytes of text whose different words are found together.
CHUNK_BYTES = 8 << 20
#: Rows of the batches between Spark and Python.
BATCH_ROWS = 250


#: How the files that WordEncoder can read normalise and split texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def check_spec(spec: dict) -> None:
    """ValueError unless a text's ids are those of its strings between white space, lower-cased, and words end in </w>: what WordEncoder takes for granted."""
    model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    plain = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    split = steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    level = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    literal = all(x["content"].startswith("<|") and not any(x.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) and len(x["content"].split()) == 1 for x in spec["added_tokens"])
    if not (plain and split and level and literal and spec.get("normalizer") == NORMALIZER and not spec.get("truncation") and not spec.get("padding")):
        raise ValueError("this tokenizer file is not of the lower-casing word kind")


class WordEncoder:
    """Ids of texts by a tokenizers file. Pieces never span white space, so the different strings between ASCII white space are encoded once for each chunk.

    Splitting, finding the different words and putting ids in their places are Arrow's work on whole chunks; nothing is kept between chunks.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            check_spec(json.load(f))
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        most = max(vocab.values())
        self.kind = np.dtype("<u2" if max(most, end_id) < 1 << 16 else "<u4")
        self.end = pa.array([np.array([end_id], self.kind).tobytes()], pa.large_binary())
        self.is_end = np.zeros(most + 1, bool)
        self.is_end[[i for s, i in vocab.items() if s.endswith("</w>")]] = True

    def _each(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for at in range(0, len(words), 4096) for e in self.tok.encode_batch_fast(words[at : at + 4096], add_special_tokens=False)]

    def _words(self, words: pa.StringArray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and counts of words of letters, encoded in runs: each is one piece, whose last token alone carries the end-of-word mark."""
        edges = np.minimum(np.arange(0, len(words) + RUN, RUN), len(words)).astype(np.int32)
        runs = pc.binary_join(pa.ListArray.from_arrays(edges, words), " ").to_pylist()
        ids, counts = [], []
        for at in range(0, len(runs), RUNS):
            for k, e in enumerate(self.tok.encode_batch_fast(runs[at : at + RUNS], add_special_tokens=False), at):
                got = np.array(e.ids, self.kind)
                ends = np.flatnonzero(self.is_end[got]) + 1
                if len(ends) == edges[k + 1] - edges[k]:
                    ids.append(got)
                    counts.append(np.diff(ends, prepend=0))
                else:  # one by one
                    some = self._each(runs[k].split(" "))
                    ids += some
                    counts.append(np.array([len(x) for x in some], np.int64))
        return ids, counts

    def _ids(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of each of different words, as bytes."""
        letters = pc.match_substring_regex(words, _WORD).to_numpy(zero_copy_only=False)
        first, others = np.flatnonzero(letters), np.flatnonzero(~letters)
        ids, counts = self._words(words.take(pa.array(first)))
        rest = self._each(words.take(pa.array(others)).to_pylist())
        counts.append(np.array([len(x) for x in rest], np.int64))
        bounds = np.cumsum(np.concatenate([[0], *counts]), dtype=np.int64) * self.kind.itemsize
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds), pa.py_buffer(np.concatenate([np.empty(0, self.kind), *ids, *rest]))])
        place = np.empty(len(words), np.int64)
        place[first], place[others] = np.arange(len(first)), np.arange(len(first), len(words))
        return coded.take(pa.array(place))

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, pa.BinaryArray]:
        """For each text the number of its ids, and the ids, end id included, as unsigned integers of kind."""
        texts = texts.fill_null("")
        # A-Z are lowered at once, which makes fewer distinct strings and the same ids; but not where a special token may be
        low, special = pc.ascii_lower(texts), pc.match_substring(texts, "<|")
        parts = pc.ascii_split_whitespace(pc.if_else(special, texts, low) if pc.any(special).as_py() else low)
        coded = parts.flatten().dictionary_encode()
        ends = parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()
        words = coded.dictionary
        heads = pc.ascii_rtrim(words, characters=_SIGNS)
        split = pc.match_substring_regex(heads, _WORD)
        tails = pc.if_else(split, pc.utf8_ltrim(words, characters=_LETTERS), "").dictionary_encode()
        heads = pc.if_else(split, heads, words).dictionary_encode()
        ids = pc.binary_join_element_wise(self._ids(heads.dictionary).take(heads.indices), self._ids(tails.dictionary).take(tails.indices), pa.scalar(b"", pa.large_binary()))
        out = pa.concat_arrays([ids, self.end]).take(pa.array(np.insert(coded.indices.to_numpy(), ends, len(ids))))
        at = np.frombuffer(out.buffers()[1], np.int64, len(out) + 1)
        bounds = np.concatenate([at[:1], at[ends + np.arange(1, len(ends) + 1)]]).astype(np.int32)
        return np.diff(bounds) // self.kind.itemsize, pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds), out.buffers()[2]])


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path, end_id)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in slices(batches, BATCH_ROWS):
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if size:
        yield pa.concat_batches(held)


class Shards:
    """Which shard a row goes to, by doc_id and then by its tie, a hash of the text.

    bounds are quantiles of doc_id, repeats kept: an id that is many of them has so many shards more, which its rows are split over by their ties. Null ids
    come first and have `nulls` shards.
    """

    def __init__(self, bounds: list[int], nulls: int):
        self.bounds, self.nulls = np.array(bounds, np.int64), nulls
        self.count = nulls + len(bounds) + 1

    def of(self, ids: pa.Array, ties: np.ndarray) -> np.ndarray:
        part = (ties.astype(np.float64) + 2.0**63) / 2.0**64
        part = np.minimum(part, np.nextafter(1, 0))
        none = ids.is_null().to_numpy(zero_copy_only=False)
        x = ids.fill_null(0).to_numpy()
        lo, hi = np.searchsorted(self.bounds, x, "left"), np.searchsorted(self.bounds, x, "right")
        known = self.nulls + lo + (part * (hi - lo)).astype(np.int64)
        return np.where(none, (part * self.nulls).astype(np.int64), known).astype(np.int32)


def _encode(path: str, end_id: int, shards: Shards):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, end_id)
        for chunk in _chunks(batches):
            counts, ids = e.encode(chunk.column(2))
            shard = pa.array(shards.of(chunk.column(0), chunk.column(1).to_numpy()))
            out = pa.RecordBatch.from_arrays([shard, chunk.column(0), chunk.column(1), pa.array(counts, pa.int64()), ids], names=["shard", "doc_id", "tie", "n", "ids"])
            del chunk, counts, ids
            pa.default_memory_pool().release_unused()
            for at in range(0, out.num_rows, BATCH_ROWS):
                yield out.slice(at, BATCH_ROWS)

    return run


_BLOCK_SCHEMA = "shard int, block long, ids_before long, n_ids long, has_escapes boolean, doc_ids array<long>, doc_counts array<long>, words binary"


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, doc_id, n, ids) sorted by shard and in a shard's order -> block rows."""
    shard, block, before, docs, counts, parts = None, 0, 0, [], [], []

    def close():
        ids = np.concatenate([np.frombuffer(p, f"<u{len(p) // n}") for p, n in zip(parts, counts, strict=True)]).astype(np.uint64)
        esc = bool((ids >> np.uint64(60)).any())
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block]), pa.array([before]), pa.array([len(ids)]), pa.array([esc]), pa.array([docs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([pack(ids).astype("<u8").tobytes()], pa.binary())], names=["shard", "block", "ids_before", "n_ids", "has_escapes", "doc_ids", "doc_counts", "words"])

    for batch in slices(batches, BATCH_ROWS):
        for s, d, n, w in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if docs and (s != shard or sum(counts) + n > BLOCK_IDS):
                yield close()
                before, block = (before + sum(counts), block + 1) if s == shard else (0, 0)
                docs, counts, parts = [], [], []
            elif s != shard:
                before, block = 0, 0
            shard = s
            docs.append(d)
            counts.append(n)
            parts.append(w)
    if docs:
        yield close()


def write_ids(docs: DataFrame, path: str, end_id: int = 1, shards: int | None = None) -> str:
    """Encode docs (doc_id, text), append end_id to each, and write shards in ascending doc_id order; returns their folder.

    Null texts are empty: the end id only. Null ids come first; rows of one id are ordered by a hash of their texts. Other columns are ignored. An
    empty table makes no block. There is a shard for each SHARD_BYTES of the table by Spark's statistics (of text, counted, where there are none), one for each core
    at least and MOST_SHARDS at most; shard bounds are
    approximate quantiles of doc_id, and an id of many rows, or null, has several shards.
    """
    spark = docs.sparkSession
    i = F.col("doc_id").cast("long")
    seen = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = shards or min(MOST_SHARDS, max(spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES)))
    marks = docs.agg(F.percentile_approx(i, [k / shards for k in range(1, shards)] or [0.5], max(10000, 2 * shards)).alias("q")).first()["q"] or []
    dealt = Shards(marks, -(-(seen["n"] - seen["known"]) * shards // max(1, seen["n"])))
    rows = docs.select(i.alias("doc_id"), F.xxhash64("text").alias("tie"), F.make_valid_utf8("text").alias("t"))
    coded = rows.mapInArrow(_encode(path, end_id, dealt), "shard int, doc_id long, tie long, n long, ids binary")
    coded = coded.repartitionById(dealt.count, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "tie", "n", "ids").select("shard", "doc_id", "n", "ids")
    out = new_path(spark, "token-ids")
    coded.mapInArrow(_block, _BLOCK_SCHEMA).write.parquet(out)
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 16):
        for i in range(batch.num_rows):
            shard, before, esc, docs, counts, words = (batch.column(c)[i].as_py() for c in range(6))
            ids = unpack(np.frombuffer(words, "<u8").astype(np.uint64), esc).astype("<u4")
            ends = np.cumsum(counts)
            starts = ends - np.array(counts)
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(starts + before, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Shards -> doc_id, start (ids of all documents before), n_tokens, ids_crc32, decoded from the files."""
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(folder)
    # one row for each shard, MOST_SHARDS and two at most
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = sums.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    docs = blocks.select("shard", "ids_before", "has_escapes", "doc_ids", "doc_counts", "words").mapInArrow(_read, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
