"""The corpus pipeline: toxicity, near-duplicates, decontamination, personal data, byte-pair coding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and reads as the next one's docs. All
but the last keep the columns of documents. A row without doc_id is no copy of another and stays; null and empty texts pass every filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm import bpe, decontaminate, near_dup, pii, toxicity
from archivolt.llm.common import keyed, materialize, maybe_broadcast, packed, same, table, unpacked
from archivolt.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the lexicon is fitted on what of docs is labelled."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest doc_id (five words, similarity 0.8). Of repeated rows of one doc_id and text that stay, one is kept.

    Rows are found by id and text, so a unique text stays though its id has other texts too. Null ids, null and empty texts stay.
    """
    found = near_dup.near_duplicates(docs, text_key=True).where("doc_id is not null")
    seen = found.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    seen = keyed(materialize(seen.where("not kept or n > 1"), "seen"))
    size = 40 * seen.count()
    rows, twice = packed(docs), seen.where("kept")
    left = rows.join(maybe_broadcast(seen.select("rd", "rk"), size), same(rows, seen), "left_anti")
    again = rows.join(maybe_broadcast(twice.select("rd", "rk"), size), same(rows, twice), "left_semi").groupBy("d", "k").agg(F.min("row").alias("row"))
    return unpacked(left, docs).union(unpacked(again, docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without the benchmark passages of the others. Null and empty texts stay; repeated rows are treated alike."""
    return decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts masked. Null and empty texts stay as they are; repeated rows are treated alike."""
    return pii.redact(docs, pii.fit(docs))


def code_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the ids of each text, and digest of the text decoded from them. Null and empty texts have no ids; each row gets a row."""
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("personal_data", mask_personal_data), ("bpe", code_tokens)]

#: The lexicon, the field and the tokenizer are not expressible in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
