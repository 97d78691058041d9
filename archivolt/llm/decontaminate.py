"""Benchmark decontamination by a broadcast hash set of test n-grams, with DataFrame functions only.

A benchmark item's windows are its runs of 13 words, or the whole item if it is shorter. Every aligned tile of m words at stride s with
m + s - 1 = 13 lies in exactly one way in each window that holds it, so a document is scanned by its tiles only: one hash and its place for s
words. Tiles are looked up in a broadcast hash set of the items' m-grams. Only documents with a hit are read once more: the windows around their
hits are compared with the items' windows word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keyed, materialize, maybe_broadcast, packed, same, unpacked

WINDOW = 13
#: Of a document's words, one in DIRTY hit is contaminated.
DIRTY = 20
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in a text that keeps its capitals.
_SIGNS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UP, _LOW), _GAPS), lambda w: w != "")


def _starts(n: Column, length: int, stride: int) -> Column:
    """0, stride, 2 * stride ... up to n - length."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def _shape(length: int) -> tuple[int, int]:
    """(m, s) of a window length: m + s - 1 = length."""
    m = (length + 1) // 2
    return m, length - m + 1


def _grams(length: int) -> Column:
    """Hashes of the m-grams of a window `win` at its s places."""
    m, s = _shape(length)
    return F.transform(F.sequence(F.lit(0), F.lit(s - 1)), lambda i: F.xxhash64(F.slice("win", i + 1, m)))


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """bench (item_id, text) -> (length, win, items): distinct windows with the sorted ids of their items, as strings. Null ids and texts without words have none."""
    b = bench.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    wins = b.select("item", length.alias("length"), F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - length), lambda i: F.slice("w", i + 1, length))).alias("win"))
    return wins.groupBy("length", "win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _documents(docs: DataFrame) -> DataFrame:
    """(d, k, t) of docs: id, hash of the text, text."""
    return docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("k"), F.col("text").alias("t"))


def _judged(docs: DataFrame, bench: DataFrame, window: int, dirty: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((d, k, n, copies) of all documents, copies being the rows that share id and text; (d, k, n_hit, hits, item_ids, contaminated) of those with hits)."""
    wins = scratch.write(benchmark_windows(bench, window), "windows")
    sizes = wins.groupBy("length").agg(F.count("*").alias("n"), F.sum(F.expr("aggregate(win, 40L, (s, x) -> s + 20 + octet_length(x)) + aggregate(items, 0L, (s, x) -> s + 20 + octet_length(x))")).alias("bytes")).collect()  # at most `window` rows
    base = _documents(docs).select("d", "k", words_of(F.col("t")).alias("w0"))
    kind = "struct<length:int,h:bigint,q:int>"

    def tiles(w: Column, length: int) -> Column:
        m, s = _shape(length)
        return F.transform(_starts(F.size(w), m, s), lambda q: F.struct(F.lit(length).alias("length"), F.xxhash64(F.slice(w, q + 1, m)).alias("h"), q.alias("q")))

    lengths = sorted(r["length"] for r in sizes)
    both = lambda w: F.struct(F.size(w).cast("long").alias("n"), F.concat(F.array().cast(f"array<{kind}>"), *(tiles(w, n) for n in lengths)).alias("tiles"))
    seen = base.select("d", "k", F.transform(F.array("w0"), both)[0].alias("x"))  # one pass over the words
    rows = seen.select("d", "k", F.col("x.n").alias("n"), F.posexplode_outer("x.tiles").alias("pos", "t")).select("d", "k", "n", F.when(F.coalesce("pos", F.lit(0)) == 0, 1).otherwise(0).alias("copy"), "t.length", "t.h", "t.q")
    known = wins.where("false").select("length", F.lit(0).cast("long").alias("h"))
    for n in lengths:  # every m-gram of every window: a tile can lie at any of the s places
        known = known.union(wins.where(F.col("length") == n).select("length", F.explode(_grams(n)).alias("h")))
    known = scratch.write(known.distinct().withColumn("known", F.lit(True)), "grams")
    held = rows.join(maybe_broadcast(known, 40 * known.count()), ["length", "h"], "left").where("copy = 1 or known")
    per = held.groupBy("d", "k").agg(F.max("n").alias("n"), F.sum("copy").cast("int").alias("copies"), F.collect_set(F.when(F.col("known"), F.struct("length", "q"))).alias("spots"))
    per = scratch.write(per, "scanned")
    some = per.where(F.size("spots") > 0).select("d", "k", "n", "spots")
    texts = _documents(docs)
    near = keyed(some.select("d", "k"))
    again = texts.join(maybe_broadcast(near, 40 * some.count()), same(texts, near), "left_semi").groupBy("d", "k").agg(F.min("t").alias("t"))
    spots = keyed(some)
    worded = again.join(spots, same(again, spots)).select("d", "k", "n", words_of(F.col("t")).alias("w"), F.explode("spots").alias("s")).select("d", "k", "n", "w", "s.length", "s.q")
    first = F.lit(0)
    for n in lengths:  # a tile lies in the windows that start up to s - 1 words before it
        first = F.when(F.col("length") == n, F.greatest(F.col("q") - (_shape(n)[1] - 1), F.lit(0))).otherwise(first)
    last = F.least("q", F.size("w") - F.col("length"))
    places = F.when(first <= last, F.sequence(first, last))
    spread = worded.select("d", "k", "n", "length", F.explode(F.transform(places, lambda p: F.struct(p.alias("p"), F.slice("w", p + 1, F.col("length")).alias("win")))).alias("s")).select("d", "k", "n", "length", "s.p", "s.win")
    hits = spread.join(maybe_broadcast(wins, sum(r["bytes"] for r in sizes)), ["length", "win"])
    found = hits.groupBy("d", "k").agg(F.max("n").alias("n"), F.sort_array(F.collect_set(F.struct("p", "length"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(x["p"] + x["length"] - F.greatest(acc["end"], x["p"]), F.lit(0))).cast("long").alias("n"), F.greatest(acc["end"], x["p"] + x["length"]).alias("end")),
        lambda acc: acc["n"],
    )
    found = found.withColumn("n_hit", covered).select("d", "k", "n_hit", "hits", "item_ids", (F.col("n_hit") * dirty >= F.col("n")).alias("contaminated"))
    return per.select("d", "k", "n", "copies"), found


def scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW, dirty: int = DIRTY) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, item_ids, hits (array of start, length), contaminated.

    Texts are lower-cased in A-Z; words are runs of digits, a-z and non-ASCII characters. Null and empty texts have no words and are clean. Rows that share
    doc_id and text are each returned; rows that share only doc_id are judged by their own texts. Null ids keep their rows. Other columns are ignored.
    Without benchmark windows every document is clean; an empty table gives an empty result.
    """
    with Scratch(docs.sparkSession, "scan") as scratch:
        per, found = _judged(docs, bench, window, dirty, scratch)
        found = keyed(found)
        out = per.join(found, same(per, found), "left")  # unique on both sides
        return materialize(out.select(F.col("d").alias("doc_id"), F.col("k").alias("text_key"), F.col("n").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("hits", F.array().cast("array<struct<p:int,length:int>>")).alias("hits"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"), F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_row")).drop("_row"), "scan")


def _parted(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of docs that are not found, rows that are, with what was found)."""
    rows, known = packed(docs), keyed(found)
    n = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(40 + 24 * F.size("hits")), F.lit(0)).alias("b")).first()
    keys = known.select("rd", "rk")
    clean = rows.join(maybe_broadcast(keys, 40 * n["n"]), same(rows, keys), "left_anti")
    return unpacked(clean, docs), rows.join(maybe_broadcast(known, n["b"]), same(rows, known))


def without_hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW, dirty: int = DIRTY) -> DataFrame:
    """docs without contaminated documents, and with the hit words of all others cut out, each with the signs after it; the rest of the text stays as it is.

    What was cut is judged again until nothing is hit, since the words around a cut can make a window. n_chars, where there is one, is the new length.
    Null and empty texts stay; repeated rows and rows of null ids are treated each alike; columns of any other name stay as they are; an empty table stays empty.
    """
    with Scratch(docs.sparkSession, "without-hits") as scratch:
        kept = None
        while True:
            found = materialize(_judged(docs, bench, window, dirty, scratch)[1], "hits")
            if not found.limit(1).count():
                return docs if kept is None else kept.union(docs)
            clean, hit = _parted(docs, found)
            kept = clean if kept is None else kept.union(clean)
            words = F.regexp_extract_all(F.col("row")["text"], F.lit(f"[^{_SIGNS}]+[{_SIGNS}]*"), F.lit(0))
            left = F.filter(words, lambda x, i: ~F.exists("hits", lambda h: (i >= h["p"]) & (i < h["p"] + h["length"])))
            cut = F.concat(F.regexp_extract(F.col("row")["text"], f"^[{_SIGNS}]*", 0), F.array_join(left, ""))
            docs = materialize(unpacked(hit.where("not contaminated"), docs, cut), "cut")


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, dirty: int = DIRTY, remove: str = "documents") -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit words of every document cut out.

    With spans, a hit text becomes its other words joined by single spaces, and n_chars, where there is one, its new length. All columns stay, whatever
    their names. Null and empty texts are clean and stay; repeated rows and rows of null ids are treated each alike; an empty table stays empty.
    """
    with Scratch(docs.sparkSession, "decontaminate") as scratch:
        found = materialize(_judged(docs, bench, window, dirty, scratch)[1], "hits")
        if remove == "documents":
            return _parted(docs, found.where("contaminated"))[0]
        clean, hit = _parted(docs, found)
        left = F.transform(F.array(words_of(F.col("row")["text"])), lambda w: F.array_join(F.filter(w, lambda x, i: ~F.exists("hits", lambda h: (i >= h["p"]) & (i < h["p"] + h["length"]))), " "))[0]
        return clean.union(unpacked(hit, docs, left))
