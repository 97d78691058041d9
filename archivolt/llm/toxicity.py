"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding homoglyphs and digit substitutions.

Entries are word beginnings and whole words, weighted by log odds of labelled documents. Matches inside exception phrases do not count. What is
matched is normalised by the text's length and turned into a probability by logistic regression.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, first_keys, fitting_texts, slices
from .language_id import held_out

#: Labelled documents of each class that the lexicon is fitted on, the first by a hash of doc_id.
FIT_DOCS = 2000
#: Toxic documents that an entry must occur in, and its least log odds.
SUPPORT, LEAST_ODDS = 4, 2.0
#: Lengths of word beginnings that can be entries, and most entries.
PREFIX, ENTRIES = (4, 12), 5000
THRESHOLD = 0.7
#: Digits and signs that stand for letters, and letters that look like plain Latin ones but have no decomposition to them.
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_CYRILLIC = dict(zip("авекмнорстухіѕјԁһԛԝѵгпиья", "abekmhopctyxisjdhqwvrnubr", strict=True))
_GREEK = dict(zip("αβεικνορτυχηωγϲϳ", "abeikvoptuxnwycj", strict=True))
_ARMENIAN = dict(zip("օսոհցզ", "ounhgq", strict=True))
_LATIN = dict(zip("ıɑɡøđłħŧƒʋʌ", "iagodlhtfva", strict=True))
_SMALL_CAPITALS = dict(zip("ᴀʙᴄᴅᴇɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "abcdeghijklmnoprstuvwyz", strict=True))
_ALIKE = _CYRILLIC | _GREEK | _ARMENIAN | _LATIN | _SMALL_CAPITALS
#: First code points of rows of 26 emoji letters.
_EMOJI_ROWS = (0x1F1E6, 0x1F150, 0x1F170)


class _Folding(dict):
    """What a character is folded to, worked out when it first occurs: its compatibility decomposition in lower case, without marks and invisible signs,
    with look-alikes and substitutions replaced; what is neither letter nor digit is a blank."""

    def __missing__(self, code: int) -> str:
        row = next((r for r in _EMOJI_ROWS if 0 <= code - r < 26), None)
        text = chr(97 + code - row) if row else unicodedata.normalize("NFKD", chr(code)).lower()
        out = ""
        for c in unicodedata.normalize("NFKD", text):
            if unicodedata.category(c) in ("Mn", "Me", "Cf"):
                continue
            c = _ALIKE.get(c, c)
            c = _LEET.get(c, c)
            out += c if c.isalnum() else " "
        self[code] = out
        return out


FOLD = _Folding()
#: A sign in place of a letter, where a letter follows; four letters or more set apart by single signs.
_BANG, _BAR, _APART = re.compile("!(?=[^\\W\\d_])"), re.compile("(?<=[^\\W\\d_])[|](?=[^\\W\\d_])"), re.compile(r"(?<= )(?:[^\W\d_] ){3,}[^\W\d_](?= )")


def fold(text: str | None) -> str:
    """Lower-cased words between single-blank borders: homoglyphs, accents, full-width and other letter forms, digit substitutions, invisible signs,
    letters set apart and punctuation folded. Null is as empty."""
    text = text or ""
    if "!" in text:
        text = _BANG.sub("i", text)
    if "|" in text:
        text = _BAR.sub("l", text)
    return _APART.sub(lambda m: m[0].replace(" ", ""), f" {text.lower().translate(FOLD)} ")


def outside(best: dict[int, float], free: list[tuple[int, int]]) -> dict[int, float]:
    """The matches whose start lies in no span [a, b) of free: one pass over both, sorted."""
    out, spans, i, reach = {}, sorted(free), 0, -1
    for s in sorted(best):
        while i < len(spans) and spans[i][0] <= s:
            reach = max(reach, spans[i][1])
            i += 1
        if s >= reach:
            out[s] = best[s]
    return out


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = (), curve: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0)):
        self.weights, self.exceptions, self.curve = weights, tuple(exceptions), curve
        self._automaton = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, s):
        self.__init__(*s)

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = a = ahocorasick.Automaton()
            for w, x in self.weights.items():
                a.add_word(w, (len(w), x))
            for e in self.exceptions:
                a.add_word(f" {e} ", (len(e) + 2, None))
            if len(a):
                a.make_automaton()
        return self._automaton

    def features(self, text: str | None) -> tuple[float, float, float]:
        """(strongest match, matched weight by hundred characters, matched weight), each on a log scale; one match for a word, the strongest."""
        return self.features_of(fold(text))

    def features_of(self, folded: str) -> tuple[float, float, float]:
        if not len(self.automaton):
            return 0.0, 0.0, 0.0
        best: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (n, x) in self.automaton.iter(folded):
            start = end - n + 1
            if x is None:
                free.append((start, end))
            else:
                best[start] = max(best.get(start, 0.0), x)
        if free:
            best = outside(best, free)
        if not best:
            return 0.0, 0.0, 0.0
        total = sum(best.values())
        return max(best.values()), math.log1p(100 * total / len(folded)), math.log1p(total)

    def score(self, text: str | None) -> float:
        z = self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _entries(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        for n in range(PREFIX[0], min(PREFIX[1], len(w)) + 1):
            out.add(" " + w[:n])
        out.add(f" {w} ")
    return out


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.1) -> np.ndarray:
    """Newton's method, both classes weighing the same; the first weight is the intercept."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + ridge * w * (np.arange(len(w)) > 0)
        h = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag([1e-9, *[ridge] * (len(w) - 1)])
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


def learn(toxic: list[str], clean: list[str]) -> Lexicon:
    """Fit lexicon, exceptions and curve; the curve is fitted on the documents that the lexicon was not, in two halves.

    With no document of a class there is no lexicon. With only one in a class, which can't be halved, the curve stays the default one.
    """
    if not toxic or not clean:
        return Lexicon({})

    def lexicon(bad: list[str], good: list[str]) -> Lexicon:
        c1, c0 = Counter(), Counter()
        for t in bad:
            c1.update(_entries(t))
        for t in good:
            c0.update(e for e in _entries(t) if e in c1)
        odds = {e: math.log((k + 0.5) / (len(bad) + 1)) - math.log((c0[e] + 0.5) / (len(good) + 1)) for e, k in c1.items() if k >= SUPPORT}
        # a beginning that occurs just where a longer entry does says no more than it, and would catch other words
        covered = {p for e, k in c1.items() if k >= SUPPORT for p in (e[:n] for n in range(PREFIX[0] + 1, len(e))) if c1.get(p) == k}
        odds = {e: x for e, x in odds.items() if e not in covered}
        strong = sorted(((e, x) for e, x in odds.items() if x >= LEAST_ODDS), key=lambda p: (-c1[p[0]] * p[1], p[0]))[:ENTRIES]
        weights = dict(strong)
        pairs1, pairs0 = Counter(), Counter()
        for texts, count in ((bad, pairs1), (good, pairs0)):
            for t in texts:
                ws = t.split()
                hot = [i for i, w in enumerate(ws) if f" {w} " in weights]
                count.update({f"{ws[i - 1]} {ws[i]}" for i in hot if i} | {f"{ws[i]} {ws[i + 1]}" for i in hot if i + 1 < len(ws)})
        return Lexicon(weights, tuple(sorted(p for p, k in pairs0.items() if k >= 3 and not pairs1[p])))

    bad, good = [fold(t) for t in toxic], [fold(t) for t in clean]
    xs, ys = [], []
    full = lexicon(bad, good)
    if len(bad) < 2 or len(good) < 2:
        return full
    for k in (0, 1):
        part = lexicon(bad[k::2], good[k::2])
        for texts, y in ((bad[1 - k :: 2], 1.0), (good[1 - k :: 2], 0.0)):
            xs += [part.features_of(t) for t in texts]
            ys += [y] * len(texts)
    return Lexicon(full.weights, full.exceptions, tuple(float(w) for w in _logistic(np.array(xs), np.array(ys))))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Lexicon:
    """Lexicon from up to fit_docs toxic and fit_docs other labelled documents, the same ones on every run; ids with crc32 % 3 = 1 are held out.

    Null ids, texts and labels, and documents labelled both ways, are left out.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).where("lo = hi")
    ids = first_keys(marks.select(F.col("hi").alias("g"), F.col("doc_id").cast("long").alias("d"), F.lit(0).cast("long").alias("k")), fit_docs)
    chosen = docs.sparkSession.createDataFrame([(d, g) for g, own in ids.items() for d, _ in own], "doc_id long, toxic int")
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * fit_docs ids
    sides = fitting_texts(marked, F.col("toxic"), fit_docs)
    return learn(sides.get(1, []), sides.get(0, []))


def _scorer(spark, lexicon: Lexicon):
    shared = spark.sparkContext.broadcast(lexicon)  # at most ENTRIES entries

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return by_slices(text, lambda texts: [shared.value.score(t) for t in texts], pa.float64())

    return score


def score_documents(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, score, predicted.

    Null and empty texts match nothing and have the lowest score. Without labels of both classes the lexicon is empty and all scores are equal and low. Row by row:
    repeated rows each get a row. A null doc_id is not held out. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = [shared.value.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text scores at least threshold; all columns stay.

    Null and empty texts score lowest and stay, unless the threshold is below their score. Row by row: repeated rows, null ids and an empty table make
    no difference, and no other column is looked at.
    """
    return docs.where(_scorer(docs.sparkSession, lexicon)(docs["text"]) < threshold)
