"""The corpus pipeline: from raw documents to token ids, one Parquet table after the other.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before has kept.
All stages but the last return the columns of ``docs``, whatever their names.

In every stage null and empty texts are clean, unlike any other document and without tokens; texts of any length
are taken whole; rows that repeat are judged alike and stay or go together, as do rows without an id by their
text; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedloom.llm.bpe import encode
from feedloom.llm.decontaminate import clean_of_benchmark
from feedloom.llm.jaccard import one_of_each
from feedloom.llm.pii import pseudonymised
from feedloom.llm.queries import PSEUDONYM_KEY
from feedloom.llm.runtime import written
from feedloom.llm.toxicity import not_toxic
from feedloom.packaging import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.7 or more go. The model learns from ``docs``."""
    ship(spark)
    return not_toxic(docs, _table(spark, sf_dir, "labels"), threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest id.

    Near: five-word shingles with a Jaccard similarity of 0.8 or more, or a chain of such pairs.
    """
    ship(spark)
    return one_of_each(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by ``benchmark`` go: a twentieth or more of the words in 13-word hits."""
    ship(spark)
    return clean_of_benchmark(docs, _table(spark, sf_dir, "benchmark"), width=13)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become format-preserving pseudonyms; no document goes."""
    ship(spark)
    return pseudonymised(docs, PSEUDONYM_KEY)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` and the packed ids (little-endian, 32 bits) of each text."""
    ship(spark)
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: The stages of scores, pseudonyms and token ids can't be said in SQL; the tests check each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
