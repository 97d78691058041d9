"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, in each slot, one bit for every language; the AND of an n-gram's slots is the set of languages whose filter
contains it. A text's per-language popcounts, corrected for each filter's false positives, decide.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitting_texts, slices

GRAM, HASHES, SLOT_BITS = 4, 3, 20
#: Documents of each language that the filters are fitted on, the first by a hash of doc_id.
FIT_DOCS = 1000
#: An n-gram enters a language's filter if its rate there is at least SHARE of its highest rate in any language, and it was seen LEAST times.
SHARE, LEAST = 0.4, 3
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, bool]:
    """(hashes of a text's n-grams over lower-cased letters with blanks between words, whether it has a letter)."""
    x = np.frombuffer((" " + (text or "").lower() + " " * (GRAM - 1)).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[x]
    x = np.where(is_letter, x, np.uint32(32)).astype(np.uint64)
    n = len(x) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = (h + x[i : i + n]) * _M1
        h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h[is_letter[1 : 1 + n]], bool(is_letter.any())


def slots(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(i * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for i in range(HASHES)]


class LanguageFilters:
    """Filters of up to 64 languages per plane; more languages take more planes."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        counts = []
        for lang in self.langs:
            c: Counter = Counter()
            for t in texts[lang]:
                u, n = np.unique(grams(t)[0], return_counts=True)
                c.update(dict(zip(u.tolist(), n.tolist(), strict=True)))
            counts.append(c)
        totals = [max(1, sum(c.values())) for c in counts]
        top: dict[int, float] = {}
        for c, n in zip(counts, totals, strict=True):
            for g, k in c.items():
                top[g] = max(top.get(g, 0.0), k / n)
        self.planes = [np.zeros(1 << SLOT_BITS, np.uint64) for _ in range(max(1, math.ceil(len(self.langs) / 64)))]
        for i, (c, n) in enumerate(zip(counts, totals, strict=True)):
            own = np.array([g for g, k in c.items() if k >= LEAST and k / n >= SHARE * top[g]], np.uint64)
            for s in slots(own):
                np.bitwise_or.at(self.planes[i // 64], s, np.uint64(1) << np.uint64(i % 64))
        self.false = np.array([float(np.mean((self.planes[i // 64] >> np.uint64(i % 64)) & np.uint64(1))) ** HASHES for i in range(len(self.langs))])

    def masks(self, h: np.ndarray) -> list[np.ndarray]:
        """For each plane, the languages that contain each n-gram."""
        at = slots(h)
        out = []
        for p in self.planes:
            m = p[at[0]]
            for s in at[1:]:
                m &= p[s]
            out.append(m)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        h, letter = grams(text)
        if not letter or not len(h) or not self.langs:
            return "und", 0.0
        m = self.masks(h)
        hits = np.array([np.count_nonzero(m[i // 64] & (np.uint64(1) << np.uint64(i % 64))) for i in range(len(self.langs))], float)
        real = np.clip((hits - len(h) * self.false) / (1 - np.minimum(self.false, 0.999)), 0, None)
        best = int(np.argmax(real))
        return self.langs[best], float(min(1.0, real[best] / max(real.sum(), 1e-9)))


def held_out(id_col):
    return F.crc32(id_col.cast("string")) % 3 == 1


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> LanguageFilters:
    """Filters from up to fit_docs documents of every language value, the same ones on every run; held-out ids, null ids and null texts are left out.

    All languages are taken in one pass. Without any such row there are no languages.
    """
    learn = docs.where(F.coalesce(~held_out(F.col("doc_id")), F.lit(False)))
    return LanguageFilters(fitting_texts(learn, F.col("lang"), fit_docs))


def identify(docs: DataFrame, filters: LanguageFilters | None = None) -> DataFrame:
    """docs (doc_id, text, lang for fitting) -> doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are `und` with score 0, as is everything where nothing could be learned. A null doc_id is not held out and not
    learned from. Ties go to the first language by name. Row by row: repeated rows each get a row. Other columns are ignored.
    """
    filters = filters or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # one table of 2^SLOT_BITS words a plane

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in slices(batches):
            got = [f.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
