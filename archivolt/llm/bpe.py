"""Byte-level BPE as a bounded-lookahead streaming transducer, and an incremental decoder.

Encoding: a text comes in pieces of bounded size. It is cut into pre-tokens as it comes, and each pre-token's bytes pass through the window of a
transducer. A token is emitted once no byte that could still arrive may change it, which holds when the window reaches `lookahead` bytes beyond the
token's end or the pre-token has ended; so memory is constant, however long a text or a pre-token is. The lookahead is computed from the merge list
(`sufficient_lookahead`). What the transducer emits for a short run without inner white space is remembered in a cache of bounded size.
Decoding: a state machine takes ids, keeps at most three bytes of an unfinished UTF-8 sequence, and gives text as soon as it is complete.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Runs whose ids a worker remembers, each of at most MEMO_CHARS; the cache is emptied when full.
MEMO, MEMO_CHARS = 200_000, 64
#: Characters of a text that are looked at together.
PIECE = 1 << 16
_SPACE = "\t-\r \x85\xa0  -     　"
#: White space runs and the rest, cut as the pre-tokenizer cuts at white space.
_CHUNKS = f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: The same, with runs of Latin-1 letters cut off where no other letter can follow: they are whole pre-tokens.
_WORDS = " ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]++(?![^\x00-\xff])|" + _CHUNKS
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_order(merges: list[tuple[int, int, int]], singles: set[int]) -> None:
    """ValueError unless every merge joins bytes or results of earlier merges, and no token is made twice: what the lookahead's proof takes for granted."""
    made = set(singles)
    for a, b, r in merges:
        if a not in made or b not in made or r in made:
            raise ValueError("the merge list is not in the order of training")
        made.add(r)


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Bytes beyond a token's end that decide it, for merges (left, right, result) by priority.

    A token's right edge can only be taken away by a merge (x, y) of x, a token on that edge, before x is merged inwards; y in turn must
    form first, and can lose its own edge only to a merge of still higher priority. So priorities along a chain of such thefts rise strictly, and the longest chain, in bytes, is
    found in one pass over the merges by priority.
    """
    made: dict[int, tuple[int, int]] = {}  # token -> (its right part, rank of its merge)
    starts: dict[int, list[tuple[int, int]]] = {}  # left part -> (rank, longest chain of its merges so far), by rank
    longest = 0

    def reach(x: int, rank: int) -> int:
        """Longest chain of a merge with left part x and a rank below `rank`."""
        rows = starts.get(x, ())
        lo, hi = 0, len(rows)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if rows[mid][0] < rank else (lo, mid)
        return rows[lo - 1][1] if lo else 0

    def beyond(token: int, rank: int) -> int:
        """Longest chain from any token on the right edge of `token`, which itself is merged at `rank`."""
        best = reach(token, rank)
        while token in made:
            token, rank = made[token]
            best = max(best, reach(token, rank))
        return best

    for rank, (a, b, r) in enumerate(merges):
        far = length[b] + beyond(b, rank)
        rows = starts.setdefault(a, [])
        rows.append((rank, max(far, rows[-1][1] if rows else 0)))
        longest = max(longest, far)
        made.setdefault(r, (b, rank))
    return longest


_NONE, _ID = 1 << 62, (1 << 32) - 1


def check_spec(spec: dict) -> None:
    """ValueError unless the file is of the kind that this transducer computes: byte-level pieces, plain merges, special tokens taken literally."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and (spec.get("decoder") or {}).get("type") == "ByteLevel"
    literal = all(not any(x.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) and x["content"] and not re.search(f"[{_SPACE}]", x["content"]) for x in spec["added_tokens"])
    if not (model["type"] == "BPE" and plain and level and literal and not spec.get("normalizer")):
        raise ValueError("this tokenizer file is not of the plain byte-level kind")


class Emitter:
    """The transducer's state for one pre-token whose bytes arrive in any pieces; at most two windows of them are kept."""

    def __init__(self, of: BytePairTransducer):
        self.of, self.held = of, bytearray()

    def push(self, data: bytes) -> list[int]:
        """Ids that no further byte can change."""
        of, out = self.of, []
        for at in range(0, len(data), of.window):
            self.held += data[at : at + of.window]
            if len(self.held) < of.window:
                continue
            done = 0
            for t in of.merged([of.single[b] for b in self.held]):
                end = done + len(of.bytes_of[t])
                if len(self.held) - end < of.lookahead:
                    break
                out.append(t)
                done = end
            del self.held[:done]
        return out

    def finish(self) -> list[int]:
        """The rest, at the end of the pre-token."""
        out = self.of.merged([self.of.single[b] for b in self.held])
        self.held.clear()
        return out


class BytePairTransducer:
    """Encoder and decoder of one vocabulary file of the byte-level kind."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_spec(spec)
        stand_in = _byte_chars()
        as_bytes = lambda s: bytes(stand_in[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: as_bytes(s) for s, i in vocab.items() if s not in self.special}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.single = [0] * 256
        for s, i in vocab.items():
            if len(s) == 1:
                self.single[stand_in[s]] = i
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merge = {(vocab[a], vocab[b]): rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}  # the rank above, the result below
        ordered = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        check_order(ordered, {i for s, i in vocab.items() if len(s) == 1})
        self.lookahead = sufficient_lookahead(ordered, {i: len(b) for i, b in self.bytes_of.items()})
        self.longest = max(len(b) for i, b in self.bytes_of.items())
        self.window = 2 * (self.lookahead + self.longest)
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.memo: dict[str, bytes] = {}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        #: What may still belong to a special token or a contraction at a piece's end.
        self.tail = max(3, *map(len, self.special), 3)
        self.fast_chunks = re.compile(_WORDS).finditer
        self.pieces = regex.compile(_PIECES)
        self.last_gap = re.compile(rf".*[^{_SPACE}](?=[{_SPACE}])", re.DOTALL).match
        self.kinds = [regex.compile(k) for k in (rf"[{_SPACE}]+", r"\p{L}+", r"\p{N}+", rf"[^{_SPACE}\p{{L}}\p{{N}}]+")]

    def merged(self, ids: list[int]) -> list[int]:
        """Merges of a short run of ids, lowest rank first, leftmost first. Changes ids in place."""
        get = self.merge.get
        ranks = [get(p, _NONE) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            ids[i] = best & _ID
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), _NONE)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), _NONE)
        return ids

    def _emitted(self, token: str) -> list[int]:
        """Ids of one whole pre-token."""
        e = Emitter(self)
        return e.push(token.encode("utf-8", "surrogatepass")) + e.finish()

    def _run(self, chunk: str) -> bytes:
        """Ids of a run without inner white space, as little-endian 32-bit integers."""
        got = self.memo.get(chunk)
        if got is None:
            got = np.array([t for m in self.pieces.finditer(chunk) for t in self._emitted(m[0])], "<u4").tobytes()
            if len(chunk) <= MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[chunk] = got
        return got

    def _closed(self, text: str) -> Iterator[bytes]:
        """Ids of a text of bounded length that ends where a pre-token ends."""
        at = 0
        for m in self.special_at.finditer(text):
            yield b"".join([self._run(c[0]) for c in self.fast_chunks(text[at : m.start()])])
            yield np.array([self.special[m[0]]], "<u4").tobytes()
            at = m.end()
        yield b"".join([self._run(c[0]) for c in self.fast_chunks(text[at:] if at else text)])

    def encode_parts(self, pieces: Iterable[str], piece: int = PIECE) -> Iterator[bytes]:
        """Ids of a text that arrives in pieces, as they become stable, as little-endian 32-bit integers.

        No more than `piece` characters (four tails at least), one arriving piece and a window are kept. A pre-token never reaches from a sign into white space, so
        the text is cut there; where a piece has no such place, its pre-tokens are taken one by one, and one that does not end stays open.
        """
        source, held, more, piece = iter(pieces), "", True, max(piece, 4 * self.tail)
        while True:
            while more and len(held) < piece:
                got = next(source, None)
                more = got is not None
                held += got or ""
            if not more:
                yield from self._closed(held)
                return
            gap = self.last_gap(held)
            if gap:
                yield from self._closed(held[: gap.end()])
                held = held[gap.end() :]
                continue
            special = self.special_at.search(held)
            if special:
                yield from self._closed(held[: special.end()])
                held = held[special.end() :]
                continue
            sure, done = len(held) - self.tail, 0
            for m in self.pieces.finditer(held):
                if m.end() >= sure:
                    break
                yield self._run(m[0])
                done = m.end()
            if done:
                held = held[done:]
                continue
            # one pre-token that reaches to the piece's end, of one kind of characters after its first
            kind = next(k for k in self.kinds if k.match(held, sure - 1))
            e = Emitter(self)
            yield np.array(e.push(held[:sure].encode("utf-8", "surrogatepass")), "<u4").tobytes()
            held = held[sure:]
            while True:
                while more and len(held) < piece:
                    got = next(source, None)
                    more = got is not None
                    held += got or ""
                special = self.special_at.search(held)
                run = kind.match(held)
                stop = run.end() if run else 0
                cut = special is not None and special.start() <= stop
                stop = special.start() if cut else stop
                if more and not cut and len(held) - stop < self.tail:
                    keep = max(0, min(stop, len(held) - self.tail))
                    yield np.array(e.push(held[:keep].encode("utf-8", "surrogatepass")), "<u4").tobytes()
                    held = held[keep:]
                    if keep:
                        continue
                    got = next(source, None)  # the tail alone: take one piece more
                    more = got is not None
                    held += got or ""
                    continue
                if kind is self.kinds[0] and stop < len(held) and not cut:
                    stop -= 1  # the last blank before a sign belongs to what follows
                yield np.array(e.push(held[:stop].encode("utf-8", "surrogatepass")) + e.finish(), "<u4").tobytes()
                held = held[stop:]
                break

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        return np.frombuffer(b"".join(self.encode_parts(text[i : i + PIECE] for i in range(0, len(text), PIECE))), "<u4")

    def decode_parts(self, parts: Iterable[bytes]) -> Iterator[str]:
        """Text of ids, which arrive in parts of little-endian 32-bit integers, as it becomes complete; bytes that are no UTF-8 become U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        get = self.table.__getitem__
        for part in parts:
            yield state.decode(b"".join(map(get, np.frombuffer(part, "<u4").tolist())))
        yield state.decode(b"", True)

    def decode(self, ids) -> str:
        ids = np.asarray(ids, "<u4")
        return "".join(self.decode_parts(ids[i : i + PIECE].tobytes() for i in range(0, len(ids), PIECE)))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them), part by part: neither is ever held whole."""
        text, n, of_ids, of_text = text or "", 0, hashlib.sha256(), hashlib.sha256()

        def noted() -> Iterator[bytes]:
            nonlocal n
            for part in self.encode_parts(text[i : i + PIECE] for i in range(0, len(text), PIECE)):
                n += len(part) // 4
                of_ids.update(part)
                yield part

        for part in self.decode_parts(noted()):
            of_text.update(part.encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()


@lru_cache(maxsize=2)
def transducer(path: str) -> BytePairTransducer:
    return BytePairTransducer(path)


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in slices(batches):
            got = [t.digests(text.as_py()) for text in batch.column(1)]
            cols = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the encoded ids and of the text decoded from them.

    Null texts are empty: no ids. Row by row, so repeated rows, null ids and empty tables give a row for each row. Other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_run(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids (array<int>); null texts have none."""

    def run(batches):
        t = transducer(path)
        for batch in slices(batches):
            ids = [t.encode(x).astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, text; null ids give an empty text, unknown ids no bytes."""

    def run(batches):
        t = transducer(path)
        for batch in slices(batches):
            texts = [t.decode([i for i in x or () if 0 <= i < len(t.table)]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
