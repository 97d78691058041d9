"""The pipeline against a plain re-computation of its stages on sf0.001."""

import hashlib
import re

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import corpus_pipeline
    from archivolt.llm import pii, toxicity
    from archivolt.llm.near_dup import shingle_set
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lex = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {r["doc_id"]: r["text"] for r in docs.collect() if lex.score(r["text"]) < toxicity.THRESHOLD}
    sets = {i: set(shingle_set(t, 5).tolist()) for i, t in left.items()}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(left):
        for j in sorted(left):
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    left = {i: t for i, t in left.items() if find(i) == i}
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    wins = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        wins |= {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
    clean = {}
    for i, t in left.items():
        w = words(t)
        hit = {p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in wins for p in range(k, k + 13)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean[i] = t
    model = pii.fit(spark.createDataFrame(list(clean.items()), "doc_id long, text string"))
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in clean.items():
        t = pii.masked(t, model.spans(t)[1])
        ids = ref.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 100 < len(got) < 200


def test_near_duplicate_stage_with_repeated_and_null_ids(spark):
    import corpus_pipeline

    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (None, None), (3, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns and sorted(((r["doc_id"] or 0), r["text"] or "-") for r in out.collect()) == [(0, "-"), (0, "a b c d e f"), (1, "a b c d e f"), (3, "-"), (3, "-")]


def test_decontamination_stage_leaves_no_passage(spark, tmp_path):
    import corpus_pipeline
    from archivolt.llm import decontaminate

    a, b = [f"a{i}" for i in range(13)], [f"B{i}" for i in range(15)]
    spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b).lower())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    much = [f"Word{i}," for i in range(700)]
    rows = {
        1: ("«" + " ".join(much) + ".\n", None),  # nothing hit: as it is
        2: ("- " + " ".join([*much[:9], *b, *much[9:]]) + "!\n", "- " + " ".join(much) + "!\n"),
        3: (" ".join([*much, *a[:6], *b, *a[6:]]), " ".join(much) + " "),  # the words around the cut make a passage
        4: (" ".join([*b, *much[:20]]), ""),  # contaminated
        5: ("", None),
        6: (None, None),
    }
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, (t, _) in rows.items()] + [(None, rows[2][0], "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    want = {i: t if w is None else w for i, (t, w) in rows.items() if w != ""} | {None: rows[2][1]}
    assert out.columns == docs.columns and got == {i: (t, None if t is None else len(t)) for i, t in want.items()}
    assert decontaminate.scan(out, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).where("n_hit > 0").count() == 0


def test_near_duplicate_stage_keeps_the_unique_text_of_a_repeated_id(spark):
    import corpus_pipeline

    rows = [(3, "a b c d e f"), (7, "A b c d e f"), (7, "g h i j k l"), (9, "g h i j k l"), (9, "m n o p q r")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in out.collect()) == [rows[0], rows[2], rows[4]]


def test_stages_keep_clashing_names_and_nulls(spark):
    import corpus_pipeline

    rows = [(1, "a text with a@b.org in it"), (1, "a text with a@b.org in it"), (None, None), (2, ""), (3, "other words")]
    names = ["_d", "_k", "row", "kept", "d", "k", "rd", "rk", "n", "key", "id", "t", "score", "tree"]
    docs = spark.createDataFrame([(i, t, "en", "s", 9, *[i] * len(names)) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(n + ' long' for n in names)}")
    for left in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, left, SF)
            assert out.columns == docs.columns
            assert sorted({(r["doc_id"] or 0, r["row"] or 0) for r in out.collect()}) == sorted({(r["doc_id"] or 0, r["doc_id"] or 0) for r in left.collect()})
        assert corpus_pipeline.STAGES[-1][1](spark, left, SF).count() == left.count()
