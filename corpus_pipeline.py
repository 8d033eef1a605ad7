"""The corpus pipeline over ``documents``: toxicity, quality rules, near and passage de-duplication, packing.

Every stage works on all that its predecessor kept. The first three drop documents, the fourth removes repeated passages
from texts (whole characters only), the last packs what remains into token sequences.

Defined cases, in every stage: a null text is empty (it fails the quality rules); rows of a null id are judged like others,
never as copies; repeated rows are judged each, and rows of one id by their own texts; of equal or near documents the
smallest id stays; an empty table gives an empty result; all columns of ``documents``, whatever their names, stay as they are
but ``text`` and ``n_chars`` of the fourth stage, which needs both. Without labels nothing is toxic and every line is content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import minhash, packing, quality, suffix_dedup, toxicity
from telemill.llm.queries import tokenizer
from telemill.llm.runtime import keep, table

ORACLE_SQL = None  # trained models and tokenizers; tests compare with a brute-force version


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_ordinary(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit_chain(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first(docs, 5, 80)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_ranges(docs, suffix_dedup.repeated_ranges(docs, 50))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), 1, 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near-duplicates", drop_near_duplicates),
    ("repeated-passages", remove_repeated_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
