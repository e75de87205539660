"""BLEU from sums: a row's clipped n-gram matches and lengths are additive, so a corpus score needs no shuffle of n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seqloom.functions.slices import row_by_row

COUNTS = T.StructType(
    [T.StructField("matches", T.ArrayType(T.LongType())), T.StructField("possible", T.ArrayType(T.LongType())), T.StructField("hyp_len", T.LongType()), T.StructField("ref_len", T.LongType())]
)


class Grams:
    """A text's tokens; its n-grams are counted when they are first asked for, once for all texts that it is held against."""

    def __init__(self, tokens: Sequence[str]):
        self.tokens, self.counted = list(tokens), []

    def of(self, n: int) -> Counter:
        while len(self.counted) < n:
            self.counted.append(Counter(zip(*(self.tokens[i:] for i in range(len(self.counted) + 1)), strict=False)))
        return self.counted[n - 1]


def counts_of(ref: Grams, hyp: Grams, order: int) -> tuple[list[int], list[int], int, int]:
    """Clipped matches and possible n-grams for n = 1 to ``order``, and both lengths."""
    size = len(hyp.tokens)
    possible = [max(size - n + 1, 0) for n in range(1, order + 1)]
    if ref.tokens == hyp.tokens:
        return list(possible), possible, size, size
    matches = [0] * order
    for n in range(1, order + 1):
        left, right = ref.of(n), hyp.of(n)
        both = left.keys() & right.keys()
        matches[n - 1] = sum(map(min, map(left.get, both), map(right.get, both)))
        if not matches[n - 1]:  # a longer match would hold a shorter one
            break
    return matches, possible, size, len(ref.tokens)


def counts(ref: Sequence[str], hyp: Sequence[str], order: int) -> tuple[list[int], list[int], int, int]:
    return counts_of(Grams(ref), Grams(hyp), order)


def count_column(order: int):
    """An Arrow function from reference and hypothesis token arrays to additive counts (null arrays count as empty)."""

    kind = pa.struct(list(to_arrow_schema(COUNTS)))

    def row(ref: list[str] | None, hyp: list[str] | None) -> dict:
        return dict(zip(COUNTS.names, counts(ref or [], hyp or [], order), strict=True))

    @F.arrow_udf(COUNTS)
    def column(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        return row_by_row(row, kind, ref, hyp)

    return column


def score(matches: Sequence[Column], possible: Sequence[Column], hyp_len: Column, ref_len: Column, smooth: bool) -> Column:
    """0 to 100. Smoothing adds one to matches and possible of every order (to all orders alike)."""
    order = len(matches)
    if smooth:
        precisions = [(m + 1.0) / (p + 1.0) for m, p in zip(matches, possible, strict=True)]
    else:
        precisions = [F.when(p > 0, m / p).otherwise(0.0) for m, p in zip(matches, possible, strict=True)]
    logs = sum((F.ln(p) for p in precisions[1:]), F.ln(precisions[0])) / order
    positive = F.least(*precisions) if order > 1 else precisions[0]
    brevity = F.when(hyp_len >= ref_len, 1.0).otherwise(F.exp(1 - F.try_divide(ref_len, hyp_len)))
    return F.when((hyp_len > 0) & (positive > 0), 100 * brevity * F.exp(logs)).otherwise(0.0)


def sentence(c: Column, order: int, smooth: bool = True) -> Column:
    """The score of one row from its counts."""
    return score([c["matches"][i] for i in range(order)], [c["possible"][i] for i in range(order)], c["hyp_len"], c["ref_len"], smooth)


def corpus_sums(c: Column, order: int, prefix: str) -> list[Column]:
    """The aggregates a corpus score needs."""
    per = [F.sum(c[k][i]).alias(f"{prefix}_{k}_{i}") for k in ("matches", "possible") for i in range(order)]
    return [*per, F.sum(c["hyp_len"]).alias(f"{prefix}_hyp"), F.sum(c["ref_len"]).alias(f"{prefix}_ref")]


def corpus(prefix: str, order: int, smooth: bool = False) -> Column:
    """The corpus score from the columns that ``corpus_sums`` made."""
    get = lambda k: [F.col(f"{prefix}_{k}_{i}") for i in range(order)]
    return score(get("matches"), get("possible"), F.col(f"{prefix}_hyp"), F.col(f"{prefix}_ref"), smooth)


def running(rows: DataFrame, c: str, order: int, index: str, reset: str | None = None) -> DataFrame:
    """``rows`` with ``bleu``: the corpus score of all rows so far in order, of the whole pass or begun anew for each value of ``reset``."""
    from seqloom.operators.running import running_totals
    from seqloom.sources.workspace import spare

    counts = F.col(c)
    names = spare(rows, *(f"{k}{i}" for k in ("matches", "possible") for i in range(order)), "hyp", "ref")
    values = [counts[k][i] for k in ("matches", "possible") for i in range(order)] + [counts["hyp_len"], counts["ref_len"]]
    total = running_totals(rows, [F.col(index)], dict(zip(names, values, strict=True)), reset)
    sums = [F.col(n) for n in names]
    return total.withColumn("bleu", score(sums[:order], sums[order : 2 * order], sums[-2], sums[-1], False)).drop(*names)


def of_files(spark: SparkSession, path: str, order: int) -> DataFrame:
    """``bleu`` of the hypotheses and references that ``write_reference_pairs`` left under ``path``; 0 without any."""
    from seqloom.functions.text import words
    from seqloom.sources import readers

    side = lambda name: readers.lines(spark, f"{path}/{name}", skip_empty=False).select("idx", words(F.col("value")).alias(name))
    counted = readers.zipped(side("hyp"), side("ref")).select(count_column(order)("ref", "hyp").alias("c"))
    return counted.agg(*corpus_sums(F.col("c"), order, "b")).select(F.coalesce(corpus("b", order), F.lit(0.0)).alias("bleu"))
