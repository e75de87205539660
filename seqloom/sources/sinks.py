"""Writers of the corpus formats, all through Spark's own sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import text
from seqloom.functions.sequences import coloured
from seqloom.sources.workspace import pinned


def write_blocks(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """Parquet files of at most ``rows`` rows."""
    df.write.option("maxRecordsPerFile", rows).parquet(path)


def write_lines(df: DataFrame, path: str, line: Column, *order: str, single: bool = False, compression: str = "none") -> None:
    """One line a row in global order: files in name order, or a single file for small results."""
    ordered = df.orderBy(*order) if order else df
    lines = ordered.select(line.cast("string").alias("value"))
    (lines.coalesce(1) if single else lines).write.option("compression", compression).text(path)


def write_records(df: DataFrame, path: str, order: str) -> None:
    """Encoded records, one a line."""
    write_lines(df, path, text.encode_record(*(F.col(c) for c in ("src", "tgt", "var_names", "score", "repo", "sha"))), order)


def write_splits(df: DataFrame, path: str, line: Column, order: str) -> None:
    """A folder a split (``split=...``), each in order over its files' names: a large split is written by many tasks."""
    rows = df.select("split", F.col(order).alias("_order"), line.cast("string").alias("value")).repartitionByRange("split", "_order").sortWithinPartitions("split", "_order")
    rows.select("split", "value").write.partitionBy("split").text(path)


def write_split_index(df: DataFrame, path: str, index: str) -> None:
    """Which rows each split has: a folder of indices a split, in order."""
    df.select("split", index).repartitionByRange("split", index).sortWithinPartitions("split", index).write.partitionBy("split").parquet(path)


def write_token_pairs(df: DataFrame, path: str, src: Column, tgt: Column, order: str) -> None:
    """Tokenised pairs, one a line: tokens by NUL, sides by the field separator."""
    write_lines(df, path, F.concat(text.join_tokens(src), F.lit(text.TUPLE), text.join_tokens(tgt)), order)


def write_sample(words: DataFrame, path: str, seed: int, key: str) -> None:
    """Sampled tokens, shuffled, one a line."""
    from seqloom.operators.corpus import hash_order

    rows = words.withColumn("_hash", hash_order(F.col(key), seed))
    write_lines(rows, path, F.col("word"), "_hash", key)


def training_lines(df: DataFrame, src: Column, tgt: Column, names: Column) -> DataFrame:
    """Two lines a row for a subword model: the source with both names of each variable, and the target."""
    join = lambda c: F.array_join(c, " ")
    return df.select(F.explode(F.array(join(text.both_names(src, names)), join(tgt))).alias("value"))


def write_report(document: DataFrame, path: str, members: int | None = None) -> None:
    """A report's lines (``ordinal, line``) as gzip members: each task writes those of its range, and names order the ranges, so the
    members one after another are one valid gzip file of one JSON document. No task holds more than a range. Lines are made once:
    dealing by range reads its input twice.
    """
    width = members or int(document.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pinned(document.select("ordinal", "line"), "lines").repartitionByRange(width, "ordinal").sortWithinPartitions("ordinal")
    ordered.select(F.col("line").alias("value")).write.option("compression", "gzip").text(path)


def write_reference_pairs(df: DataFrame, path: str, hyp: Column, ref: Column, order: str) -> None:
    """Hypotheses and references, line by line in the same order, in two folders."""
    write_lines(df, f"{path}/hyp", hyp, order)
    write_lines(df, f"{path}/ref", ref, order)


def write_scores(scored: DataFrame, path: str, order: str, value: str) -> None:
    """One number a line in row order; rows without a score have an empty line."""
    write_lines(scored, path, F.coalesce(F.col(value).cast("string"), F.lit("")), order)


def write_merged(joined: DataFrame, path: str, line: Column, order: str, then: str) -> None:
    """Matched rows in the order of what asked for them, then the leftovers."""
    rows = joined.orderBy(F.asc_nulls_last(order), then).select(line.alias("value"))
    rows.write.text(path)


def annotated(rows: DataFrame, src: str, tgt: str, hyp: str, score: str, index: str) -> DataFrame:
    """Coloured blocks of source, target and hypothesis, worst scores first: ``index, score, block``."""
    @F.pandas_udf("string")
    def block(s: pd.Series, t: pd.Series, h: pd.Series) -> pd.Series:
        def one(a: str, b: str, c: str) -> str:
            left, right = coloured(b, c)
            return f"source: {a}\ntarget: {left}\nhypothesis: {right}\n"

        return pd.Series([one(*(x or "" for x in r)) for r in zip(s, t, h, strict=True)], dtype="object")

    return rows.select(F.col(index).alias("index"), F.col(score).alias("score"), block(src, tgt, hyp).alias("block")).orderBy("score", "index")
