"""Personal data by a skip-chain conditional random field over base patterns.

The base patterns find e-mails, IPs, payment cards and phones. Loosely written candidates (other separators, spelled-out signs, a missing plus) become
nodes as well. Neighbouring nodes share a chain potential; distant nodes with the same or a similar value share a skip potential, and loopy message
passing carries labels along both, so an entity found once is labelled the same wherever the document repeats it. Base nodes are clamped, so base spans
always stay; the method only adds spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, fitting_texts, slices

KINDS = ("email", "ip", "card", "phone")
#: Documents that the potentials are fitted on, the first by a hash of doc_id.
FIT_DOCS = 2000
#: Posterior at which a candidate becomes a span.
SURE = 0.9
ROUNDS = 20
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NON_DIGIT = re.compile("[^0-9]")
#: Loose candidates: digit groups with any of these separators, and e-mails with spelled-out signs.
_LOOSE_DIGITS = re.compile(r"\(?[0-9](?:[ ()./_-]{0,2}[0-9]|\[\.\][0-9]){7,}+")
_LOOSE_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]++)++")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, sorted; leftmost non-overlapping per kind, failing matches dropped. Linear in the text."""
    out: list[tuple[int, int, int]] = []
    if not text:
        return out
    if "@" in text:
        last = 0
        for m in _AT.finditer(text):
            i = m.start()
            while i > last and text[i - 1] in _LOCAL:
                i -= 1
            if i < m.start():
                out.append((i, 0, m.end()))
                last = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = _NON_DIGIT.sub("", m[0])
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NON_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _value(kind: int, raw: str) -> str:
    """What repeats of an entity have in common: digits, or the bare address."""
    if kind == 0 or "@" in raw or "(" in raw and "at" in raw.lower() or "[" in raw and "at" in raw.lower():
        v = re.sub(r" ?[(\[]at[)\]] ?", "@", re.sub(r" ?[(\[]dot[)\]] ?", ".", raw.lower()))
        return "m" + v
    return _NON_DIGIT.sub("", raw)


def _keys(value: str) -> list[str]:
    """Link keys of a value: itself, and of what is similar: numbers with the same last ten digits (a phone without its country code) or the same first
    twelve (a card or number that goes on or breaks off), addresses with the same name at another host or the same host's name spelled with another ending."""
    if value.startswith("m"):
        name, _, host = value[1:].partition("@")
        return [value, "n" + name, "h" + name[:3] + host.partition(".")[0]] if host else [value]
    return [value, *(["t" + value[-10:]] if len(value) >= 10 else []), *(["f" + value[:12]] if len(value) >= 14 else [])]


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind or -1, end) of base spans and of the loose candidates that overlap none, sorted."""
    cand = [(m.start(), m.end()) for m in _LOOSE_DIGITS.finditer(text)] if _DIGIT.search(text) else []
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        cand += [(m.start(), m.end()) for m in _LOOSE_MAIL.finditer(text)]
    out, j, reach = list(base), 0, -1
    for a, b in sorted(cand):
        while j < len(base) and base[j][0] < b:
            reach = max(reach, base[j][2])
            j += 1
        if a >= reach:
            out.append((a, -1, b))
            reach = b
    return sorted(out)


def _features(text: str, a: int, b: int) -> np.ndarray:
    raw = text[a:b]
    d = _NON_DIGIT.sub("", raw)
    n = len(d)
    x = [1.0, "@" in raw or "(at)" in raw.lower() or "[at]" in raw.lower(), raw.count(".") == 3 and 4 <= n <= 12, n < 10, 10 <= n <= 13, 14 <= n <= 19, n > 19, 14 <= n <= 19 and luhn(d), raw[:1] == "+", any(c in raw for c in " ()-")]
    return np.array(x, float)


N_FEATURES = 10
_O = len(KINDS)


def edges_of(text: str, nodes: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain edges, skip edges). Repeats of a key are joined one to the next: messages pass along the whole row of repeats, while edges stay linear in
    the nodes (all pairs of n repeats would be n * n / 2)."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1)]
    last: dict[str, int] = {}
    skip = set()
    for i, (a, k, b) in enumerate(nodes):
        for key in _keys(_value(k, text[a:b])):
            if key in last:
                skip.add((last[key], i))
            last[key] = i
    return chain, sorted(skip)


class SkipChain:
    """Potentials: local weights (labels x features) and agreement weights of chain and skip edges."""

    def __init__(self, local: np.ndarray | None = None, chain: float = 0.0, skip: float = 6.0):
        if local is None:
            local = np.zeros((_O + 1, N_FEATURES))
            local[_O, 0] = 2.0
        self.local, self.chain, self.skip = local, chain, skip

    def posteriors(self, text: str, nodes: list[tuple[int, int, int]]) -> np.ndarray:
        """Beliefs (nodes x labels) by loopy sum-product messages, base nodes clamped."""
        n = len(nodes)
        unary = np.stack([self.local @ _features(text, a, b) for a, _, b in nodes])
        for i, (_, k, _) in enumerate(nodes):
            if k >= 0:
                unary[i] = -50.0
                unary[i, k] = 0.0
        chain, skip = edges_of(text, nodes)
        weight = dict.fromkeys(chain, self.chain)  # two edges between the same nodes are one of both weights
        for e in skip:
            weight[e] = weight.get(e, 0.0) + self.skip
        pairs = [(i, j, w) for (i, j), w in weight.items()]
        src = np.array([p[0] for p in pairs] + [p[1] for p in pairs], int)
        dst = np.array([p[1] for p in pairs] + [p[0] for p in pairs], int)
        gain = np.expm1(np.array([p[2] for p in pairs] * 2))
        back = np.r_[len(pairs) : 2 * len(pairs), 0 : len(pairs)]
        msg = np.zeros((len(src), _O + 1))
        belief = unary.copy()
        for _ in range(ROUNDS if len(src) else 0):
            out = belief[src] - msg[back]
            out = np.exp(out - out.max(1, keepdims=True))
            out /= out.sum(1, keepdims=True)
            new = np.log1p(gain[:, None] * out)  # agreement weight w: sum over labels of p * exp(w * same)
            new -= new.mean(1, keepdims=True)
            moved = np.abs(new - msg).max()
            msg = 0.5 * msg + 0.5 * new
            belief = unary.copy()
            np.add.at(belief, dst, msg)
            if moved < 1e-4:
                break
        p = np.exp(belief - belief.max(1, keepdims=True))
        return (p / p.sum(1, keepdims=True)).reshape(n, -1)

    def spans(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(base spans, all spans), sorted (start, kind, end)."""
        base = base_spans(text)
        if not text:
            return base, base
        nodes = nodes_of(text, base)
        if len(nodes) == len(base):
            return base, base
        p = self.posteriors(text, nodes)
        best = p.argmax(1)
        more = [(a, int(best[i]), b) for i, (a, k, b) in enumerate(nodes) if k < 0 and best[i] != _O and p[i, best[i]] >= SURE]
        return base, sorted(base + more)


def learn(texts: list[str], rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> SkipChain:
    """Pseudo-likelihood fit: base spans are the labels, other candidates are outside; a node's neighbours enter with their labels.

    Without any base span the default potentials stay. The skip weight is at least its default's half, so that a clamped repeat decides.
    """
    xs, ys, near = [], [], []
    for t in texts:
        nodes = nodes_of(t, base_spans(t))
        if not nodes:
            continue
        y = [k if k >= 0 else _O for _, k, _ in nodes]
        around = np.zeros((len(nodes), 2, _O + 1))
        for kind, edges in enumerate(edges_of(t, nodes)):
            for i, j in edges:
                around[i, kind, y[j]] += 1
                around[j, kind, y[i]] += 1
        xs += [_features(t, a, b) for a, _, b in nodes]
        ys += y
        near += list(around)
    if not xs or all(y == _O for y in ys):
        return SkipChain()
    x, y, a = np.array(xs), np.array(ys), np.array(near)
    onehot = np.eye(_O + 1)[y]
    start = SkipChain()
    local, pair = start.local.copy(), np.array([0.0, start.skip])
    for _ in range(rounds):
        z = x @ local.T + a[:, 0] * pair[0] + a[:, 1] * pair[1]
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True) - onehot
        local -= rate * (d.T @ x / len(x) + ridge * local)
        pair -= rate * ((d[:, None, :] * a).sum((0, 2)) / len(x) + ridge * pair)
    return SkipChain(local, float(np.clip(pair[0], 0, 2)), float(max(pair[1], start.skip / 2)))


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> SkipChain:
    """Potentials from up to fit_docs texts that hold a digit or an at sign, the same ones on every run. Null ids and texts are left out."""
    return learn(fitting_texts(docs, F.lit(1), fit_docs, F.col("text").rlike("[0-9@]")).get(1, []))


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: SkipChain) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    Counts by kind and the digest are of base spans, `spans` lists all, in code points, and n_spans is their number. Null and empty texts have none. Row by row: repeated rows, null ids and
    empty tables give a row for each row. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            got = [m.spans(t) for t in batch.column(1).to_pylist()]
            cols = [pa.array([sum(k == kind for _, k, _ in b) for b, _ in got], pa.int64()) for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array([hashlib.sha256(_listed(b).encode()).hexdigest() for b, _ in got], pa.string()), pa.array([_listed(s) for _, s in got], pa.string()), pa.array([len(s) for _, s in got], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span replaced by <kind>; a span that overlaps an earlier one only extends it."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: SkipChain) -> DataFrame:
    """docs with all spans of `text` masked; all columns stay, and n_chars, where there is one, is the new length.

    Null and empty texts stay as they are. Row by row: repeated rows, null ids and an empty table make no difference, and no other column is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def clean(text: pa.Array) -> pa.Array:
        return by_slices(text, lambda texts: [masked(t, shared.value.spans(t)[1]) for t in texts], pa.string())

    out = docs.withColumn("text", clean(docs["text"]))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
