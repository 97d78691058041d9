"""Edge cases and brute-force checks of the ten operators on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from archivolt.llm import bpe, chat_format, decontaminate, embedding_join, language_id, near_dup, pii, token_files, toxicity, url_filter  # noqa: E402
from archivolt.llm.common import by_slices  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, a int, b int, key string, id string, tile string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None if t is None else "en", "s", None, 1, 2, "k", "i", "t") for i, t in texts], DOCS)


WORDS = [f"w{i}" for i in range(400)]


def near_texts(rng):
    base = [rng.choice(WORDS) for _ in range(120)]
    texts = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 5, 8))):
            t[rng.randrange(len(t))] = rng.choice(WORDS)
        texts.append(" ".join(t))
    texts += [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 200))) for _ in range(30)]
    texts += ["", None, "   \n", "Two Words", "two words", "x" * 5000, texts[0], texts[0].upper()]
    return texts


def brute_components(sets, percent):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def crowd_texts(rng):
    """Texts that share most words, but too few; some differ from another one by a word or more, around the threshold."""
    common = [f"c{i}" for i in range(150)]
    texts = []
    for i in range(300):
        own = [f"u{i}_{j}" for j in range(38)]
        if i % 3 == 1:
            own = texts[rng.randrange(len(texts))].split()[150:]
            for _ in range(rng.randrange(1, 9)):
                own[rng.randrange(38)] = f"v{i}_{rng.randrange(99)}"
        texts.append(" ".join(common + own))
    return texts


@pytest.mark.parametrize("make", [near_texts, crowd_texts])
def test_near_duplicates(spark, make):
    texts = make(random.Random(5))
    out = {r["doc_id"]: r for r in near_dup.near_duplicates(docs_of(spark, list(enumerate(texts))), words=4).collect()}

    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    assert [out[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [out[i]["component_id"] for i in range(len(texts))] == brute_components(sets, 80)
    assert all(out[i]["kept"] == (out[i]["component_id"] == i) for i in out)


def test_near_duplicates_nulls_and_empty(spark):
    rows = near_dup.near_duplicates(docs_of(spark, [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, None)])).collect()
    assert len(rows) == 4 and sorted((r["doc_id"] or -1, r["kept"]) for r in rows) == [(-1, False), (1, True), (1, True), (2, True)]
    assert near_dup.near_duplicates(docs_of(spark, [])).count() == 0


def test_near_duplicate_estimate():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:900], rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    _, s = near_dup.signature([a, b])
    per = near_dup.PERMS // 64
    diff = sum(((int(s[0, w]) ^ int(s[1, w])) | (int(s[0, per + w]) ^ int(s[1, per + w])) & (2**64 - 1)).bit_count() for w in range(per))
    same = 1 - diff / near_dup.PERMS
    assert abs((same - 0.25) / 0.75 - 900 / 1100) < 0.12


def test_url_filter(spark):
    urls = [(1, "http://A.Example.NET/en/x?q"), (2, "http://a.example.net/xx"), (3, "https://b.example.com/de/"), (4, "ftp://k.org/fr/1#f"), (5, None), (6, "no scheme"), (7, "http://bad.test/a"), (8, "http://net"), (9, "http://good.test/a\nb"), (7, "http://bad.test/a")]
    urls += [(100 + i, "http://bad.test/p") for i in range(40)] + [(200 + i, "http://good.test/p") for i in range(40)]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in urls], "page_id long, url string, host string, k int")
    labels = spark.createDataFrame([(100 + i, 0, 1) for i in range(40)] + [(200 + i, 1, 0) for i in range(40)] + [(None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = url_filter.judge_urls(pages, labels).collect()
    assert len(rows) == len(urls)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == ("net/", "block") and got[3][2:] == ("example.com/de/", "block")
    assert got[4] == ("k.org", "/fr/1", "org/fr/", "allow") and got[5] == got[6] == ("", "", None, "allow") and got[7][3] == "block" and got[8] == ("net", "", None, "allow") and got[9][1] == "/a\nb"
    none = url_filter.judge_urls(pages, labels.limit(0))
    assert {r["verdict"] for r in none.where("rule is null").collect()} == {"allow"} and url_filter.judge_urls(pages.limit(0), labels).count() == 0


def test_pii_base_patterns_against_regex():
    rng = random.Random(2)
    parts = [*"0123456789", "@", ".", "-", " ", "+", "(", ")", "a", "b.c", "%", "@x.y", "12.3.4.5", "4012 8888 8888 1881", "é", "\n"]
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))
        want = []
        for k, p in enumerate(kinds):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                ok = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15)[k]
                want += [(m.start(), k, m.end())] * ok
        assert pii.base_spans(t) == sorted(want)


def test_pii_field_and_redaction(spark):
    model = pii.SkipChain()
    t = "Card 4012888888881881, again 4012.8888.8888.1881; id 1234567890123456; a.b@c.org or a.b (at) c (dot) org"
    base, spans = model.spans(t)
    assert len(base) == 2 and [(pii.KINDS[k], t[a:b]) for a, k, b in spans][1] == ("card", "4012.8888.8888.1881") and len(spans) == 4
    docs = docs_of(spark, [(1, t), (2, None), (3, ""), (None, "plain"), (5, "1" * 20000), (1, t)])
    rows = pii.find(docs, pii.fit(docs)).collect()
    assert len(rows) == 6 and {r["doc_id"]: r["base_sha256"] for r in rows}[2] == hashlib.sha256(b"").hexdigest()
    out = pii.redact(docs, model)
    assert out.columns == docs.columns and out.where("doc_id = 1").first()["text"].count("<card>") == 2
    assert pii.find(docs.limit(0), model).count() == 0
    plain = "nothing here 2024-01-01 and 12 items at 3.5"
    assert model.spans(plain) == ([], [])


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for i in range(200):
        n = int(rng.integers(0, 400))
        ids = (rng.integers(0, 2**63, n, dtype=np.uint64) * 2) >> rng.integers(0, 64, n).astype(np.uint64)
        ids = ids % 50000 if i % 3 == 0 else ids
        assert (token_files.unpack(token_files.pack(ids)) == ids).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ref = Tokenizer.from_file(path)
    rng = random.Random(1)
    parts = ["a", "Th", "ÉR", " ", "\n", "́", "e", "ß", "0", "'s", "!", ".", "...", "　", "<|endoftext|>", "日本", "\xa0", "İ", "Σ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(200)] + [None, "", "word " * 30000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = docs_of(spark, [(i * 3, texts[i]) for i in order])
    got = {r["doc_id"]: r for r in token_files.read_digests(spark, token_files.write_ids(docs, path, 1)).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = [*ref.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i * 3]["start"], got[i * 3]["n_tokens"], got[i * 3]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read_digests(spark, token_files.write_ids(docs.limit(0), path, 1)).count() == 0
    same = token_files.read_digests(spark, token_files.write_ids(docs_of(spark, [(1, "x"), (1, "x"), (None, "y")]), path, 1)).collect()
    assert sorted((r["start"], r["n_tokens"]) for r in same) == [(0, 2), (2, 2), (4, 2)]


def test_word_encoder_in_chunks(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ref = Tokenizer.from_file(path)
    rng = random.Random(11)
    parts = [*"abzÀÖ×÷ßÿé!.,'<|>&#@~^_-0 9\t\n\x0b\x0c\x1c\x85\xa0́İΣſKﬁ日🔥", "<|endoftext|>", "don't", "ABC", "\x00", "</w>", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 50))) for _ in range(3000)] + [None, "", " ", "x" * 9000, "word, " * 20000]
    monkeypatch.setattr(token_files, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(token_files, "BATCH_ROWS", 7)
    rows = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "tie", "t"])
    for end_id, width in ((1, 2), (70_000, 4)):
        out = list(token_files._encode(path, end_id, token_files.Shards([], 0))(iter([rows.slice(0, 0), *(rows.slice(at, 100) for at in range(0, len(texts), 100))])))
        assert all(b.num_rows <= 7 for b in out)
        got = pa.Table.from_batches(out).to_pydict()
        assert got["doc_id"] == list(range(len(texts)))
        for t, n, ids in zip(texts, got["n"], got["ids"], strict=True):
            assert n * width == len(ids) and np.frombuffer(ids, f"<u{width}").tolist() == [*ref.encode(t or "", add_special_tokens=False).ids, end_id]


def test_embedding_join(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((3, 64))
    rows = [(i, [float(x) for x in (centre[i % 3] + rng.standard_normal(64) * rng.choice((0.05, 0.2, 0.27, 1.0))).astype(np.float32)], i % 2) for i in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, None, 0), (203, [0.0] * 64, 0), (204, [float("nan")] * 64, 0), (205, rows[0][1], None), (206, [1.0, 0.0], 0), (207, [2.0, 0.0], 0), (208, [], 0), (209, [None, 1.0], 0)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, rep int")
    names = ("TILE", "SPLIT", "LISTED", "SHARE")
    old = [getattr(embedding_join, n) for n in names]
    runs = []
    try:
        for new in ((2048, 2048, 16, 1 / 3), (16, 8, 0.5, 0.9), (8, 4, 1000, 0.9)):  # as it is, tiles that count, split cells that list
            for n, x in zip(names, new, strict=True):
                setattr(embedding_join, n, x)
            runs.append(sorted(embedding_join.near_vectors(df).collect()))
    finally:
        for n, x in zip(names, old, strict=True):
            setattr(embedding_join, n, x)
    assert runs[0] == runs[1] == runs[2]
    got = {r["vec_id"]: r for r in runs[0]}
    vs = {i: np.array(e, float) for i, e, la in rows if e and la is not None and None not in e and np.isfinite(e).all() and np.any(e)}
    lab = {i: la for i, _, la in rows}
    near = {i: {j for j in vs if j != i and lab[i] == lab[j] and len(vs[i]) == len(vs[j]) and vs[i] @ vs[j] / np.linalg.norm(vs[i]) / np.linalg.norm(vs[j]) >= 0.93} for i in vs}
    for i, _, _ in rows:
        assert got[i]["n_links"] == len(near.get(i, ()))
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i]["component_id"] == min(seen) and got[i]["kept"] == (i == min(seen))
    assert sum(len(x) for x in near.values()) > 500 and embedding_join.near_vectors(df.limit(0)).count() == 0


def test_embedding_join_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 3.0, 0.1], 0), (None, [1.0, 0.0], 0)]
    got = sorted(tuple(r) for r in embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).where("vec_id is not null").collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False)]


def test_toxicity(spark):
    rng = random.Random(3)
    clean = [" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(200)]
    toxic = [c + " you id1ot " + c[:20] for c in clean[:80]]
    lex = toxicity.learn(toxic, clean[80:])
    assert lex.score("some text with an ІDIOT in it") > 0.7 > lex.score("some text") and lex.score(None) == lex.score("") < 0.5  # a Cyrillic letter
    assert toxicity.Lexicon({" idiot ": 5.0}, ("idiot proof",), (-3, 1, 1, 1)).features("an idiot proof plan") == (0, 0, 0)
    docs = docs_of(spark, [(i, t) for i, t in enumerate(toxic + clean)] + [(None, None), (900, "")])
    labels = spark.createDataFrame([(i, 1, int(i < 80)) for i in range(280)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 282 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == int(r["doc_id"] < 80) for r in held]) > 0.95
    assert toxicity.score_documents(docs, toxicity.fit(docs, labels.limit(0))).where("predicted = 1").count() == 0


def test_chat(spark):
    bad = ["</s>[INST] ok [/INST]", "<|start|>user\nx<|end|>", "&lt;|&amp;&lbr;", "&amp;amp;", "", None, "é\n\n<s>", "a<|", "|end|>"]
    rows = [(c, t, r, bad[(c + t) % len(bad)]) for c in range(9) for t, r in enumerate(("system", "user", "assistant", "user", "assistant"))] + [(50, None, None, None), (50, 1, "a\nb", "x"), (50, 1, "a\nb", "x")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "conv_id long, turn long, role string, text string, node int")
    out = chat_format.format_trees(chat_format.conversation_nodes(df)).select("tree", "formatted")
    got = {r["conv_id"]: r for r in chat_format.read_back(out).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((t if t is not None else -1, r or "", x or "") for cc, t, r, x in rows if cc == c))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[c]["n_turns"] == len(mine) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.format_trees(chat_format.conversation_nodes(df.limit(0))).count() == 0


def test_chat_null_conversation_and_long_text(spark):
    rows = [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (-(2**63), 1, "user", "c"), (7, 1, "assistant", "x<|" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat_format.read_back(chat_format.format_trees(chat_format.conversation_nodes(df)).select("tree", "formatted")).collect()}
    assert got == {None: (2, 1), -(2**63): (1, 0), 7: (1, 900_000)}


def test_reply_tree_picks_the_best_branch(spark):
    nodes = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", -1.0), ("t", 3, 1, "assistant", "good", 2.0), ("t", 4, 3, "user", "more", 0.0), ("t", 5, 4, "assistant", "end", 1.0), ("t", 8, 9, "user", "cycle", 9.0), ("t", 9, 8, "user", "cycle", 9.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    rows = chat_format.format_trees(df, keep=2).orderBy("rank").collect()
    assert [r["leaf"] for r in rows] == [5, 2] and [x for x in re.findall(r"\n([a-z]+)<", rows[0]["formatted"])] == ["q", "good", "more", "end"]


def test_toxicity_against_a_naive_matcher():
    """Scores by the automaton against a plain search of every entry, with exceptions tested one by one."""
    rng = random.Random(6)
    weights = {" idio": 3.0, " idiot ": 4.0, " fool ": 2.0, " foo": 1.0, " stu": 2.5}
    lex = toxicity.Lexicon(weights, ("foolish fool", "idiot proof", "fool proof"), (-3.0, 0.5, 0.7, 0.2))
    words = ["idiot", "idiotic", "fool", "foolish", "proof", "stupid", "fine", "day", "ídiot", "f00l", "i.d.i.o.t"]
    for n in [*range(40), 400]:
        text = " ".join(rng.choice(words) for _ in range(n))
        folded = toxicity.fold(text)
        free = [(i, i + len(e) + 1) for e in lex.exceptions for i in range(len(folded)) if folded.startswith(f" {e} ", i)]
        best = {}
        for w, x in weights.items():
            for i in range(len(folded)):
                if folded.startswith(w, i) and not any(a <= i < b for a, b in free):
                    best[i] = max(best.get(i, 0), x)
        total = sum(best.values())
        want = (max(best.values()), np.log1p(100 * total / len(folded)), np.log1p(total)) if best else (0, 0, 0)
        assert np.allclose(lex.features(text), want)


def test_toxicity_folding_and_a_long_text():
    import time

    for x in ("!diot", "idïot", "𝓲𝓭𝓲𝓸𝓽", "ıdıot", "i.d.i.o.t", "1d10t", "ІDIOT", "Ｉｄｉｏｔ", "🅸🅳🅸🅾🆃", "i\u200bdiot"):
        assert toxicity.fold(x) == " idiot "
    assert toxicity.fold("¡Qué día, A!").split() == ["que", "dia", "a"]
    lex = toxicity.Lexicon({" idiot ": 4.0}, ("idiot proof",), (-3.0, 1.0, 1.0, 1.0))
    t = time.time()
    assert lex.score("idiot proof day " * 333_334) < 0.1 < 0.9 < lex.score("idiot " * 1_000_000)
    assert time.time() - t < 60
    assert toxicity.learn(["bad words"], ["good words", "more good"]).curve == (-3.0, 0.0, 0.0, 0.0) and toxicity.learn([], ["x"]).weights == {}


def test_fits_do_not_depend_on_partitions(spark):
    rows = [(i % 40, f"text {i % 90} of the number {i} or so with idiot {i % 7}", "en" if i % 2 else "de") for i in range(400)] + [(3, "a text of three", "en")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (None, 1)], "doc_id long, toxic int")
    a, b = docs.coalesce(1), docs.repartition(5)
    x, y = (toxicity.fit(d, labels, 9) for d in (a, b))
    assert (x.weights, x.exceptions, x.curve) == (y.weights, y.exceptions, y.curve)
    x, y = (language_id.fit(d, 9) for d in (a, b))
    assert x.langs == y.langs == ["de", "en"] and all((p == q).all() for p, q in zip(x.planes, y.planes, strict=True))
    x, y = (pii.fit(d, 9) for d in (a, b))
    assert (x.local == y.local).all() and x.skip == y.skip


def test_language_against_plain_sets():
    """Popcounts by the filters against plain sets: no n-gram is missed, and what is added stays within the false-positive rate."""
    rng = random.Random(4)
    texts = {la: [" ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(200)) for _ in range(20)] for la, alphabet in (("aa", "abcde"), ("bb", "defgh"), ("cc", "xyzé"))}
    f = language_id.LanguageFilters(texts)
    counts = {la: {} for la in texts}
    for la, some in texts.items():
        for t in some:
            for g in language_id.grams(t)[0].tolist():
                counts[la][g] = counts[la].get(g, 0) + 1
    rate = {la: {g: n / sum(c.values()) for g, n in c.items()} for la, c in counts.items()}
    own = {la: {g for g, n in c.items() if n >= language_id.LEAST and rate[la][g] >= language_id.SHARE * max(r.get(g, 0) for r in rate.values())} for la, c in counts.items()}
    seen = extra = 0
    for t in [*(x for some in texts.values() for x in some[:3]), "".join(rng.choice("pqrstuv ") for _ in range(20000))]:
        h = language_id.grams(t)[0]
        m = f.masks(h)[0]
        for i, la in enumerate(f.langs):
            got = (m >> np.uint64(i) & np.uint64(1)).astype(bool)
            want = np.array([g in own[la] for g in h.tolist()])
            assert (got | ~want).all()
            extra += int((got & ~want).sum())
            seen += len(h)
        best = max(f.langs, key=lambda la: sum(g in own[la] for g in h.tolist()))
        if any(g in own[best] for g in h.tolist()):
            assert f.predict(t)[0] == best
    assert extra <= 1e-3 * seen
    assert f.predict("abcde " * 200_000)[0] == "aa" and f.predict("12 !")[0] == "und"
    tie = language_id.LanguageFilters({"q": ["same words here " * 5], "p": ["same words here " * 5]})
    assert tie.predict("same words")[0] == "p"


def test_pii_beliefs_against_exact_marginals():
    """Loopy beliefs against sums over all labelings: equal on chains, near on graphs with cycles."""
    import itertools

    model = pii.SkipChain(chain=0.4, skip=1.5)
    model.local = np.random.default_rng(2).normal(0, 0.6, model.local.shape)
    for text, near in (("ring 555 010 2000 or 555 010 3000 or 555 010 4444", 1e-3), ("a@b.org then +1 555 010 2000, 555-010-2000 then 555.010.2000", 0.06), ("5550102000 x 5550102000 y 5550102000", 1e-3)):
        nodes = pii.nodes_of(text, pii.base_spans(text))
        chain, skip = pii.edges_of(text, nodes)
        unary = np.array([model.local @ pii._features(text, a, b) for a, _, b in nodes])
        exact = np.zeros_like(unary)
        for labels in itertools.product(range(len(pii.KINDS) + 1), repeat=len(nodes)):
            if any(k >= 0 and labels[i] != k for i, (_, k, _) in enumerate(nodes)):
                continue
            w = np.exp(sum(unary[i, y] for i, y in enumerate(labels)) + sum(model.chain for i, j in chain if labels[i] == labels[j]) + sum(model.skip for i, j in skip if labels[i] == labels[j]))
            for i, y in enumerate(labels):
                exact[i, y] += w
        exact /= exact.sum(1, keepdims=True)
        assert len(nodes) >= 3 and np.abs(model.posteriors(text, nodes) - exact).max() < near


def test_language(spark):
    rng = random.Random(1)
    frags = {"aa": ["th", "er", "on", "ing"], "bb": ["ung", "sch", "ein", "ich"], "cc": ["eau", "oi", "que", "ré"]}
    texts = [(i, " ".join("".join(rng.choice(frags[la]) for _ in range(3)) for _ in range(30)), la) for i, la in enumerate(["aa", "bb", "cc"] * 60)]
    docs = spark.createDataFrame([(*t, 5) for t in [*texts, (500, None, "aa"), (501, "12 34 !", "bb"), (502, "", None), (None, "thering", "cc")]], "doc_id long, text string, lang string, held_out int")
    rows = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert np.mean([rows[i]["lang_pred"] == la for i, _, la in texts if rows[i]["held_out"]]) == 1
    assert rows[500]["lang_pred"] == rows[501]["lang_pred"] == rows[502]["lang_pred"] == "und" and len(rows) == 184 and 0 <= rows[0]["score"] <= 1
    assert language_id.identify(docs.limit(0)).count() == 0


def test_decontaminate(spark):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(n))) for i, n in enumerate((20, 13, 14, 5, 1, 3, 40))] + [(90, None), (91, "..."), (None, "x y z"), (92, "Ümlaut ÉTÉ tail")]
    texts = []
    for i in range(60):
        t = [rng.choice(WORDS[:60]) for _ in range(rng.randrange(0, 90))]
        for _ in range(i % 3):
            w = (rng.choice(items[:7])[1]).upper().split()
            a = rng.randrange(len(w))
            at = rng.randrange(len(t) + 1)
            t[at:at] = w[a:] if i % 2 else w
        texts.append((i, ", ".join(t)))
    texts += [(100, None), (101, ""), (102, "!!!"), (5, texts[5][1]), (7, "other text of that id"), (None, items[0][1]), (103, "ümlaut étÉ tail"), (104, "Ümlaut ÉTÉ tail")]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, h int")

    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    want = []
    for d, t in texts:
        w, hit, ids = words(t), set(), set()
        for i, b in items:
            x = words(b)
            if i is None or not x:
                continue
            n = min(13, len(x))
            wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    ids.add(str(i))
        want.append((d if d is not None else -1, len(w), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w)))
    docs = docs_of(spark, texts)
    got = [(r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in decontaminate.scan(docs, bench).collect()]
    assert sorted(got) == sorted(want)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not x[4] for x in want)
    cut = decontaminate.decontaminate(docs, bench, remove="spans")
    assert cut.count() == len(texts) and decontaminate.scan(cut, bench).where("doc_id = 104").first()["n_words"] == 0
    assert decontaminate.scan(docs, bench.limit(0)).where("contaminated").count() == 0 and decontaminate.scan(docs.limit(0), bench).count() == 0


def test_decontaminate_clashing_names_and_a_long_text(spark):
    item = " ".join(f"b{i}" for i in range(13))
    long = " ".join(f"w{i % 5000}" for i in range(300_000))
    rows = [(1, item, 1), (2, f"{long} {item} end", 2), (3, None, 3), (None, f"{long[:4000]} {item}", 4), (4, "fine", 5)]
    names = ["_d", "_k", "_hits", "_rn", "row", "rd", "rk", "d", "k", "hits", "n"]
    docs = spark.createDataFrame([(i, t, *[x] * len(names)) for i, t, x in rows], f"doc_id long, text string, {', '.join(n + ' int' for n in names)}")
    bench = spark.createDataFrame([(1, item, 0)], "item_id long, text string, known int")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.scan(docs, bench).collect()} == {1: 13, 2: 13, 3: 0, None: 13, 4: 0}
    out = decontaminate.without_hits(docs, bench)
    assert out.columns == docs.columns and {r["doc_id"]: (r["text"], r["row"]) for r in out.collect()} == {2: (f"{long} end", 2), 3: (None, 3), None: (f"{long[:4000]} ", 4), 4: ("fine", 5)}
    assert sorted(r["_k"] for r in decontaminate.decontaminate(docs, bench).collect()) == [2, 3, 4, 5] and decontaminate.decontaminate(docs, bench, remove="spans").where("doc_id = 1").first()["text"] == ""


def test_bpe_against_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, ref = bpe.transducer(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    parts = ["a", "th", " ", "\n", "  ", "é", "ª", "0", "'s", "!", "　", "\x1c", "\x85", " ", " ", "<|endoftext|>", "日本", "🔥", "ł", "\xa0", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(800)] + ["ab" * 3000, "=" * 2500, " " * 3000]
    for x in texts:
        ids = ref.encode(x, add_special_tokens=False).ids
        assert t.encode(x).tolist() == ids and t.decode(ids) == ref.decode(ids, skip_special_tokens=False)
    for k in ("a", "ab", "the", "etaoin"):
        s = "".join(rng.choice(k) for _ in range(2000))
        e = bpe.Emitter(t)
        assert [x for i in range(0, 2000, 7) for x in e.push(s[i : i + 7].encode())] + e.finish() == ref.encode(s, add_special_tokens=False).ids
    for _ in range(400):  # texts in pieces, with runs longer than a piece
        x = "".join(rng.choice([*parts, "'", "<|", "<|endof", "text|>", "12"]) * rng.choice((1, 1, 3, rng.randrange(1, 300))) for _ in range(rng.randrange(0, 12)))
        k = rng.randrange(1, 40)
        got = b"".join(t.encode_parts((x[i : i + k] for i in range(0, len(x), k)), piece=64))
        assert np.frombuffer(got, "<u4").tolist() == ref.encode(x, add_special_tokens=False).ids
    rows = bpe.round_trip(docs_of(spark, [(1, "a b"), (1, "a b"), (2, None), (None, "<|endoftext|>x")]), path).collect()
    assert len(rows) == 4 and sorted(r["n_tokens"] for r in rows) == [0, 2, 2, 2]
    back = bpe.decode_ids(bpe.encode_ids(docs_of(spark, [(1, "héllo wörld\n")]), path), path).first()["text"]
    assert back == "héllo wörld\n" and bpe.round_trip(docs_of(spark, []), path).count() == 0


def test_bpe_memory_is_constant():
    import tracemalloc

    t = bpe.transducer(public_tokenizers.path("byte_bpe_50k.json"))
    line = "The quick brown fox, 12 times, jumps over " + "x" * 700 + " lazy dogs. "
    sum(map(len, t.encode_parts([line] * 10)))
    tracemalloc.start()
    size = sum(len(p) for p in t.encode_parts(line for _ in range(1500)))  # 1.1 MB of text
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 600_000 and peak < 1_500_000


def test_bpe_refuses_other_files():
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    bpe.check_spec(spec)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"content": "<a b>", "id": 1}]}):
        with pytest.raises(ValueError):
            bpe.check_spec(spec | change)
    with pytest.raises(ValueError):
        token_files.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), 1)
    bpe.check_order([(1, 2, 3), (3, 1, 4)], {1, 2})
    for bad in ([(3, 1, 4), (1, 2, 3)], [(1, 2, 3), (1, 2, 3)]):
        with pytest.raises(ValueError):
            bpe.check_order(bad, {1, 2})


def test_token_files_split_hot_ids(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ref = Tokenizer.from_file(path)
    rng = random.Random(9)
    rows = [(None if i % 3 == 0 else 50 if i % 3 == 1 else i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 9)))) for i in range(600)]
    folder = token_files.write_ids(docs_of(spark, rows), path, 1, shards=9)
    blocks = spark.read.parquet(folder)
    for where in ("doc_ids[0] is null", "exists(doc_ids, x -> x = 50)"):
        assert blocks.where(where).select("shard").distinct().count() >= 3
    got = sorted(token_files.read_digests(spark, folder).collect(), key=lambda r: r["start"])
    want = sorted((-1 if i is None else i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows for ids in [[*ref.encode(t, add_special_tokens=False).ids, 1]])
    mine = [(-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got]
    assert sorted(mine) == want and [m[0] for m in mine] == [w[0] for w in want]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()[:-1]]


def test_components_of_hubs_and_chains(spark):
    from archivolt.llm.common import Scratch, connected_components

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1000, 1200)] + [(5, i) for i in range(2000, 2400)] + [(7, 7), (5, 2000), (1100, 3)]
    rng.shuffle(edges)
    with Scratch(spark, "test") as s:
        got = {r["id"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), s).collect()}
        none = connected_components(spark.createDataFrame([(1, 1)], "a long, b long"), s).count()
    assert got == {i: 3 for i in [3, *range(1000, 1201)]} | {i: 5 for i in [5, *range(2000, 2400)]} and none == 0


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_minhash", "op5_embedding_join", "op7_chat_format", "op9_decontaminate"])
def test_query_against_sql(spark, name):
    import duckdb

    from archivolt.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got = queries.queries()[name](spark, "/root/testdata/sf0.001")
    cols = sorted(got.columns)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key) == sorted((tuple(r[names.index(c)] for c in cols) for r in want.fetchall()), key=key)


def test_by_slices_keeps_order_and_nulls():
    values = [None if i % 7 == 0 else "x" * (i % 5) for i in range(25)]
    for rows in (1, 4, 25, 100):
        got = by_slices(pa.array(values, pa.string()), lambda some: [None if v is None else len(v) for v in some], pa.int64(), rows)
        assert got.to_pylist() == [None if v is None else len(v) for v in values]
    assert by_slices(pa.array([], pa.string()), list, pa.string()).to_pylist() == []
