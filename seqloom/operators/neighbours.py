"""Neighbours in the sorted order of texts: an index of sorted runs that any number of tables can be looked up in.

The distinct texts are dealt by range, and each range (a run) is cut into blocks of a few texts, written with the text just before
and the one just after the block. A block starts at its fence, the shortest string that separates it from the text before it. A
lookup finds a row's run by binary search in the runs' fences, its block among the run's fences, and both neighbours in the block, as
they can't be anywhere else. Only the fences of runs are sent to the rows, a short string for each ``RUN`` texts; rows meet
fences and blocks by joins on numbers, so few rows fetch few blocks, and many rows are spread over the blocks.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.operators.corpus import ranged
from seqloom.sources.workspace import pinned, spare

#: Texts of a run and of a block.
RUN, BLOCK = 16_384, 64


@F.pandas_udf(T.StringType())
def separator(before: pd.Series, low: pd.Series) -> pd.Series:
    """The shortest start of ``low`` that is above ``before`` (the empty string, if nothing is before)."""
    return pd.Series([low_ if low_ is None else "" if b is None else low_[: len(commonprefix((b, low_))) + 1] for b, low_ in zip(before, low, strict=True)], dtype="object")


@dataclass(frozen=True)
class Index:
    """``fences``: ``run, first_block, fences array<string>``; ``blocks``: ``block, texts array<string>, before, after``; ``runs``: the fence
    and number of each run, in order."""

    fences: DataFrame
    blocks: DataFrame
    runs: tuple[tuple[str, int], ...]

    @staticmethod
    def of(train: DataFrame, key: str, run: int = RUN, block: int = BLOCK) -> Index:
        """An index of the texts in ``key``; null ones are left out, repeated ones count once."""
        texts = pinned(train.select(F.col(key).alias("text")).where("text IS NOT NULL").distinct(), "texts")
        width = max(1, -(-texts.count() // run))
        rows = ranged(texts, [F.col("text")], "run", "place", width)
        cut = rows.groupBy("run", F.floor(F.col("place") / block).alias("nth")).agg(F.sort_array(F.collect_list("text")).alias("texts"))  # ``block`` texts each
        numbered = cut.select("run", (F.col("run") * F.lit(1 << 32) + F.col("nth")).alias("block"), "texts")
        held = pinned(numbered, "blocks")
        edges = held.select("run", "block", F.get("texts", F.lit(0)).alias("low"), F.element_at("texts", -1).alias("high"))
        ends = edges.groupBy("run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        along = Window.partitionBy(F.lit(0)).orderBy("run")  # a row a run
        outer = ends.select("run", F.lag("high").over(along).alias("run_before"), F.lead("low").over(along).alias("run_after"))
        here = Window.partitionBy("run").orderBy("block")
        inner = edges.withColumn("before", F.lag("high").over(here)).withColumn("after", F.lead("low").over(here)).join(F.broadcast(outer), "run")
        placed = inner.select("run", "block", F.coalesce("before", "run_before").alias("before"), F.coalesce("after", "run_after").alias("after"), "low")
        placed = pinned(placed.withColumn("fence", separator("before", "low")).drop("low"), "fences")
        fences = placed.groupBy("run").agg(F.min("block").alias("first_block"), F.sort_array(F.collect_list("fence")).alias("fences"))  # run / block strings each
        starts = sorted((r.fence, r.run) for r in placed.groupBy("run").agg(F.min("fence").alias("fence")).collect())
        blocks = held.select("block", "texts").join(placed.select("block", "before", "after"), "block")
        return Index(pinned(fences, "runs"), pinned(blocks, "index"), tuple(starts))

    def neighbours(self, test: DataFrame, key: str, ident: str) -> DataFrame:
        """``ident, text, left_text, right_text`` of the rows of ``test`` whose text isn't null: the last indexed text up to theirs and the
        first one above it (null where none is). An indexed text equal to theirs is on the left. Any ids will do, null ones too."""
        rows = test.where(F.col(key).isNotNull()).select(F.col(ident).alias(ident), F.col(key).alias("text"))
        if not self.runs:
            return rows.withColumn("left_text", F.lit(None).cast("string")).withColumn("right_text", F.lit(None).cast("string"))
        shared = test.sparkSession.sparkContext.broadcast(([f for f, _ in self.runs], [r for _, r in self.runs]))

        @F.pandas_udf(T.IntegerType())
        def run_of(text: pd.Series) -> pd.Series:
            fences, runs = shared.value
            return pd.Series([runs[bisect_right(fences, t) - 1] for t in text], dtype="int32")

        run, block = spare(rows, "run", "block")
        fences = self.fences.select(F.col("run").alias(run), "first_block", "fences")
        nth = F.size(F.filter("fences", lambda f: f <= F.col("text"))) - 1
        routed = rows.withColumn(run, run_of("text")).join(fences, run).select(ident, "text", (F.col("first_block") + nth).alias(block))
        met = routed.join(self.blocks.withColumnRenamed("block", block), block)
        below, above = (F.filter("texts", lambda x: x <= F.col("text")), F.filter("texts", lambda x: x > F.col("text")))
        return met.select(ident, "text", F.coalesce(F.array_max(below), "before").alias("left_text"), F.coalesce(F.array_min(above), "after").alias("right_text"))
