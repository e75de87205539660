"""Preparing examples for training: ids, lengths, padding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import text
from seqloom.operators.corpus import dense_index
from seqloom.sources.workspace import spare


def length_mode(df: DataFrame, src: str, tgt: str, mode: str = "discard", max_src: int = 1024, max_tgt: int = 1024, ratio: tuple[float, float] = (0.5, 3.0)) -> DataFrame:
    """Discards pairs out of bounds, or cuts both sides to leave room for one token."""
    if mode == "truncate":
        return df.withColumn(src, text.truncated(F.col(src), max_src)).withColumn(tgt, text.truncated(F.col(tgt), max_tgt))
    if mode != "discard":
        raise ValueError(f"no such mode: {mode!r}")
    return df.where(text.fits(F.col(src), F.col(tgt), max_src, max_tgt, ratio))


def lookup(tokens: Column, vocab: dict[str, int], unknown: int) -> Column:
    """Ids by a literal map: for vocabularies known to be small."""
    table = F.create_map(*[F.lit(x) for kv in vocab.items() for x in kv])
    return F.transform(tokens, lambda t: F.coalesce(table[t], F.lit(unknown)))


def encode_subwords(tokens: Column, model_file: str) -> Column:
    """Each token cut by a subword model, all pieces in one list; each worker loads the model once."""

    @F.pandas_udf("array<string>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for batch in batches:
            yield pd.Series([None if row is None else [p for t in row for p in model.encode(t, out_type=str, num_threads=1)] for row in batch])

    return encode(tokens)


def process(pairs: DataFrame, *, vocab: dict[str, int], end_id: int, unknown: int = 1, names: str | None = None, which: str = "decomp", model_file: str | None = None, mode: str = "discard", max_src: int = 1024, max_tgt: int = 1024) -> DataFrame:
    """Token pairs (``src_tokens, tgt_tokens``) with ``src_ids, tgt_ids``: names put in, cut into subwords, bounded, ended."""
    out = pairs
    if names:
        out = out.withColumn("src_tokens", text.substitute_names(F.col("src_tokens"), F.col(names), which))
    if model_file:
        for side in ("src_tokens", "tgt_tokens"):
            out = out.withColumn(side, encode_subwords(F.col(side), model_file))
    out = length_mode(out, "src_tokens", "tgt_tokens", mode, max_src, max_tgt)
    ended = lambda c: F.concat(lookup(F.col(c), vocab, unknown), F.array(F.lit(end_id)))
    return out.withColumn("src_ids", ended("src_tokens")).withColumn("tgt_ids", ended("tgt_tokens"))


def collate(batched: DataFrame, *, start_id: int, end_id: int, batch: str = "batch_id") -> DataFrame:
    """Rows padded (with the end id) to their batch's width, with the decoder's input one to the right."""
    source, target = spare(batched, "source_width", "target_width")
    width = batched.groupBy(batch).agg(F.max(F.size("src_ids")).alias(source), F.max(F.size("tgt_ids")).alias(target))
    wide = batched.where("src_ids IS NOT NULL AND tgt_ids IS NOT NULL").join(width, batch)
    out = text.padded(F.col("tgt_ids"), F.col(target), end_id)
    return (
        wide.withColumn("source_length", F.size("src_ids")).withColumn("target_length", F.size("tgt_ids")).withColumn("source", text.padded(F.col("src_ids"), F.col(source), end_id))
        .withColumn("target_output", out).withColumn("target_input", text.shifted(out, start_id)).drop(source, target)
    )


def cached(df: DataFrame) -> DataFrame:
    """A source kept in memory, and on disk where that is full, for repeated passes; ``unpersist`` lets go of it."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def first_split(df: DataFrame, splits: list[str]) -> DataFrame:
    """The rows of the first of the named splits: validation uses no other."""
    return df.where(F.col("split") == splits[0])


def every(df: DataFrame, order: list[Column], step: int) -> DataFrame:
    """Every ``step``-th row in order with its ``place``: what is logged as samples of output."""
    return dense_index(df, order, "place").where((F.col("place") + 1) % step == 0)
