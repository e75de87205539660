"""Contamination checks: each test text against its neighbours in the sorted order of training texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequences import lcs_length
from seqloom.operators.neighbours import Index


def neighbours(train: DataFrame, test: DataFrame, key: str, ident: str) -> DataFrame:
    """``ident, text, left_text, right_text``: the training texts just before and after each test text (null where none is).

    A training text equal to a test text comes before it. For several test tables make one ``Index`` and ask it for each.
    """
    return Index.of(train, key).neighbours(test, key, ident)


def overlap_ratio(a: Column, b: Column) -> Column:
    """The longest common subsequence's share of the longer side; null if either side is null, 0 for two empty ones."""
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.coalesce(F.try_divide(lcs_length(a, b), F.greatest(F.size(a), F.size(b))), F.lit(0.0)))


def scores(found: DataFrame, ident: str, tokens) -> DataFrame:
    """``ident, overlap``: the larger ratio of the two neighbours; null where there is no neighbour."""
    left, right = overlap_ratio(tokens(F.col("text")), tokens(F.col("left_text"))), overlap_ratio(tokens(F.col("text")), tokens(F.col("right_text")))
    return found.select(ident, F.greatest(left, right).alias("overlap"))


def flagged(scored: DataFrame, threshold: float = 0.8) -> DataFrame:
    return scored.where(F.col("overlap") > threshold)


def histogram(scored: DataFrame, bins: int = 70) -> DataFrame:
    """``bin, n`` over [0, 1]."""
    return scored.where("overlap IS NOT NULL").groupBy(F.least(F.floor(F.col("overlap") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
