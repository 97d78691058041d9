"""The registered queries of the ten operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, embedding_join, language_id, near_dup, pii, token_files, toxicity, url_filter
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_ids(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_files.read_digests(spark, folder)


def op5_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own.select("conv_id", "t.turn", "t.role", F.lit(said)))
    return chat_format.read_back(chat_format.format_trees(chat_format.conversation_nodes(turns)).select("tree", "formatted"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_url_filter, op2_minhash, op3_pii, op4_token_files, op5_embedding_join, op6_toxicity, op7_chat_format, op8_language, op9_decontaminate, op10_bpe)
    return {f.__name__: f for f in own}


_PARTS = """parts AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages))"""


def _prior(level: str, mean: str) -> str:
    m = f"least(greatest({mean}, 1e-6), 1 - 1e-6)"
    rho = f"greatest(coalesce(sum((k - n * {m}) * (k - n * {m}) - n * {m} * (1 - {m})) / sum({m} * (1 - {m}) * n * (n - 1)), 0.0), 1e-9)"
    return f"(SELECT least(greatest(1 / {rho} - 1, 2.0), 1000.0) FROM {level} WHERE n >= 2)"


OP1 = f"""
WITH {_PARTS},
marked AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
named AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name FROM parts),
placed AS (SELECT *, regexp_matches(name, '^([0-9]+[.]){{3}}[0-9]+$') OR starts_with(name, '[') AS ip FROM named),
hosts AS (SELECT host, CASE WHEN ip THEN name ELSE regexp_extract(name, '([^.]*[.])?[^.]*$') END AS domain, CASE WHEN ip THEN '[ip]' ELSE regexp_extract(name, '[^.]*$') END AS suffix, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k
  FROM placed LEFT JOIN marked ON page_id = doc_id GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
top AS (SELECT (sum(k) + 0.5) / (sum(n) + 1) AS m0 FROM suffixes),
s1 AS (SELECT *, m0 AS m FROM suffixes, top),
m1 AS (SELECT suffix, (k + s * m0) / (n + s) AS m FROM s1, (SELECT {_prior('s1', 'm')} AS s)),
d1 AS (SELECT d.*, m FROM domains d JOIN m1 USING (suffix)),
m2 AS (SELECT domain, (k + s * m) / (n + s) AS m FROM d1, (SELECT {_prior('d1', 'm')} AS s)),
h1 AS (SELECT h.*, m FROM hosts h JOIN m2 USING (domain)),
ab AS (SELECT host, k + s * m AS a, n - k + s * (1 - m) AS b FROM h1, (SELECT {_prior('h1', 'm')} AS s)),
blocked AS (SELECT host FROM ab WHERE a / (a + b) - 1.0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5),
ruled AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

OP2 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.d),
comp AS (SELECT d, min(c) AS c FROM reach GROUP BY d)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, w.doc_id = c AS kept FROM w LEFT JOIN sizes USING (doc_id) JOIN comp ON d = w.doc_id
"""

OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0 AND isfinite(list_dot_product(e, e))),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.93),
reach(d, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.d),
comp AS (SELECT d, min(c) AS c FROM reach GROUP BY d)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN comp ON d = vec_id
"""


def _escaped(c: str) -> str:
    for a, b in chat_format.ESCAPES:
        c = f"replace({c}, '{a}', '{b}')"
    return c


OP7 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  CAST(sum(length({_escaped('role')}) + length({_escaped('text')}) + {len(chat_format.START) + len(chat_format.END) + 1}) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

_W9 = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP9 = f"""
WITH d AS (SELECT doc_id, {_W9} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 13) AS l FROM (SELECT item_id, {_W9} AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS s FROM b),
spots AS (SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) AS p, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS s FROM d, (SELECT DISTINCT l FROM b) WHERE len(w) >= l),
hits AS (SELECT doc_id, p, l, item_id FROM spots JOIN wins USING (l, s)),
cover AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1, "op2_minhash": OP2, "op5_embedding_join": OP5, "op7_chat_format": OP7, "op9_decontaminate": OP9}
