"""Raw documents to token ids, in five stages. Each works on all that the one before kept.

Stages return the columns of ``documents`` (the last returns ids). Rows that a stage doesn't reject or change pass through
as they are, null ids and texts included.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import byte_bpe, mixing, ngram_join, surrogates, toxicity
from seqloom.llm.common import pinned, table

SURROGATE_KEY = "seqloom pipeline"


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects (score of 0.7 and above) go."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id."""
    return ngram_join.one_of_each(docs)


def private_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates; ``n_chars`` follows."""
    replaced = surrogates.with_surrogates(docs, SURROGATE_KEY)
    return replaced.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents come, whole, as often as the mix takes them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids, decoded again for their digests."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_copies_out),
    ("pii", private_data_out),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]
#: Stages that hand out a table which they have written already.
WRITTEN = {"pii"}
#: Hashed learning, keyed surrogates and BPE merges have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        if name not in WRITTEN:
            docs = pinned(docs, f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
