"""Draws without replacement from a bag that is known only by its counts.

How many of the drawn items are of one kind is hypergeometric, given how many are left to draw and what is left in the bag; so
counts are drawn kind by kind and no bag is ever laid out. Kinds fall into buckets by a digest: the draws are first shared out over
buckets by their sums, a row a bucket, then every bucket shares out its own among its kinds, a task at a time. Each draw inverts the
distribution at a number that the digest of its name gives, so a seed fixes the sample on any number of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.corpus import drawn_number
from seqloom.sources.workspace import pinned

#: Buckets by two digits of the digest; more digits for more kinds than tasks should work through one after another.
DIGITS = 2
#: Beyond so many standard deviations nothing is drawn in any number of lifetimes: their chances are below 1e-30.
SPREAD = 12


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """The least k whose chance of at most k good ones among ``draws`` is above ``u``; for counts of any size.

    Chances are relative to the likeliest k, by sums of logarithms of the ratios of neighbours, which are exact in whole numbers up to
    rounding; no factorial of a large number is taken.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low >= high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    deviation = math.sqrt(draws * (good / total) * (bad / total) * max(0.0, (total - draws) / max(1, total - 1)))
    reach = int(SPREAD * deviation) + 60
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)  # ratios of the chance of k + 1 to that of k
    with np.errstate(divide="ignore"):
        ratio = np.log(float(good) - k) + np.log(float(draws) - k) - np.log(k + 1) - np.log(float(bad - draws) + k + 1)
    weight = np.concatenate(([0.0], np.cumsum(ratio)))
    chance = np.cumsum(np.exp(weight - weight.max()))
    return first + int(np.searchsorted(chance / chance[-1], u, "right").clip(0, last - first))


def shared_out(kinds: Sequence[tuple[str, int]], draws: int, seed: int) -> list[int]:
    """How many of ``draws`` each of the kinds (name, count) gets, in the order given."""
    left, out = sum(n for _, n in kinds), []
    for name, n in kinds:
        got = hypergeometric(n, left - n, draws, drawn_number(name, seed) / 2**52) if draws else 0
        out.append(got)
        left, draws = left - n, draws - got
    return out


def draw_counts(counts: DataFrame, size: int, seed: int, *, digits: int = DIGITS) -> DataFrame:
    """``word, n``: how often each word is among ``size`` draws from the bag in which it lies ``count`` times; words that aren't drawn are left out.

    Counts may be of any size. The bag's sums are decimals of 38 digits. Rows of one word count together, null words are one more
    word, counts below 1 are no part of the bag; a larger size than the bag's gives all of it.
    """
    digest = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("word")), F.lit("")), F.lit(":"), F.lit(str(seed))))
    rows = counts.where("count > 0").groupBy("word").agg(F.sum(F.col("count").cast("decimal(38,0)")).alias("count"))
    placed = pinned(rows.select("word", "count", digest.alias("at"), F.substring(digest, 1, digits).alias("bucket")), "bag")
    sums = sorted((r.bucket, int(r.n)) for r in placed.groupBy("bucket").agg(F.sum("count").alias("n")).collect())  # a row a bucket
    drawn = dict(zip((b for b, _ in sums), shared_out(sums, min(size, sum(n for _, n in sums)), seed), strict=True))
    shared = counts.sparkSession.sparkContext.broadcast(drawn)

    def share(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by("at")
        kinds = list(zip(table.column("at").to_pylist(), map(int, table.column("count").to_pylist()), strict=True))
        got = np.array(shared_out(kinds, shared.value[key[0].as_py()], seed), np.int64)
        hit = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([table.column("word").take(pa.array(hit)).combine_chunks(), pa.array(got[hit])], names=["word", "n"])

    live = placed.where(F.col("bucket").isin([b for b, n in drawn.items() if n]))
    return live.groupBy("bucket").applyInArrow(share, "word string, n long")


def draw(counts: DataFrame, size: int, seed: int, *, digits: int = DIGITS) -> DataFrame:
    """``word`` drawn ``size`` times (``draw_counts`` laid out, a stretch of copies at a time)."""
    step = 1 << 16
    found = draw_counts(counts, size, seed, digits=digits)
    stretches = found.select("word", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("at"))
    return stretches.select("word", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + step, F.col("n")) - 1)).alias("copy")).select("word")
