"""Words cut into the likeliest pieces of a unigram vocabulary.

A vocabulary is a table of pieces and scores: logarithms of chances in millionths, whole numbers, so that sums are exact and what is
equally likely is so on every machine. ``piece_vocabulary`` takes one from the counts of a corpus. A word, with a mark in front, is cut where the sum of its pieces' scores is largest: one pass over its characters, and at each of them a
walk down a trie of all pieces. Each distinct word of a batch is cut once, and frequent words once a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from sys import intern

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.slices import by_elements
from seqloom.operators.corpus import VOCABULARY_ROWS

#: Before each word, so that pieces tell where words begin.
MARK = "▁"
#: What an unknown character costs more than the least likely piece.
UNKNOWN_COST = 10_000_000
#: Words that a task remembers: the first ones it meets, so frequent ones are among them.
KNOWN = 200_000


class Trie:
    """Pieces by their characters. A node's number is given out as pieces are added; steps are looked up by node and character."""

    def __init__(self, pieces: Iterable[tuple[str, int]]):
        self.steps: dict[tuple[int, str], int] = {}
        self.scores: dict[int, int] = {}
        nodes, worst = 1, 0
        for piece, score in pieces:
            at = 0
            for c in piece:
                if (to := self.steps.get((at, c))) is None:
                    to = self.steps[at, c] = nodes
                    nodes += 1
                at = to
            self.scores[at] = score
            worst = min(worst, score)
        self.unknown = worst - UNKNOWN_COST

    def cut(self, word: str) -> list[str]:
        """The likeliest pieces of ``word``; of equally likely cuts the one whose last piece is longest, and so on before it. A character
        that starts no piece is one by itself."""
        n = len(word)
        best, start = [0] + [-math.inf] * n, [0] * (n + 1)
        steps, scores = self.steps, self.scores
        for i in range(n):
            here, at, alone = best[i], 0, True
            for j in range(i, n):
                at = steps.get((at, word[j]), 0)
                if not at:
                    break
                if (score := scores.get(at)) is not None:
                    alone = alone and j > i
                    if here + score > best[j + 1]:  # an earlier start is kept where both are alike
                        best[j + 1], start[j + 1] = here + score, i
            if alone and here + self.unknown > best[i + 1]:
                best[i + 1], start[i + 1] = here + self.unknown, i
        out, j = [], n
        while j:
            out.append(intern(word[start[j] : j]))  # one object a piece, however many words are remembered
            j = start[j]
        return out[::-1]


def piece_vocabulary(counts: DataFrame, size: int, longest: int = 6) -> DataFrame:
    """``piece, score``: of all parts of marked words (``word, count``) of up to ``longest`` characters the ``size`` that cover most text, and
    every single character; scored by its share of all their occurrences."""
    marked = counts.select(F.concat(F.lit(MARK), "word").alias("w"), "count").where("w IS NOT NULL")
    places = marked.select("w", "count", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("i"))
    parts = places.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("w") - F.col("i") + 1)), lambda k: F.substr("w", F.col("i"), k))).alias("piece"), "count")
    summed = parts.groupBy("piece").agg(F.sum("count").alias("n"))
    most = summed.where(F.length("piece") > 1).orderBy(F.desc(F.col("n") * F.length("piece")), "piece").limit(size)
    chosen = most.unionByName(summed.where(F.length("piece") == 1))
    total = chosen.agg(F.sum("n")).scalar()
    return chosen.select("piece", F.round(F.ln(F.col("n") / total) * 1_000_000).cast("long").alias("score"))


def cut_words(df: DataFrame, index: str, tokens: Column, vocab: DataFrame) -> DataFrame:
    """``index, pieces``: the pieces of all words in order (null for null words' lists; null words count as empty).

    A vocabulary is bounded by the size it was made with, and checked, so it goes to the rows.
    """
    rows = vocab.select("piece", "score").limit(VOCABULARY_ROWS + 1).collect()
    if len(rows) > VOCABULARY_ROWS:
        raise ValueError(f"a vocabulary of more than {VOCABULARY_ROWS} pieces")
    shared = df.sparkSession.sparkContext.broadcast([(r.piece, r.score) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = Trie(shared.value), {}
        for b in (part for whole in batches for part in by_elements(whole)):
            lists = b.column(1)
            coded = pc.fill_null(lists.flatten(), "").dictionary_encode()
            cut = []
            for w in coded.dictionary.to_pylist():
                if (pieces := known.get(w)) is None:
                    pieces = trie.cut(MARK + w) if w else []
                    if len(known) < KNOWN:
                        known[w] = pieces
                cut.append(pieces)
            pool = pa.array([p for pieces in cut for p in pieces], pa.string())
            width = np.array([len(p) for p in cut], np.int64)
            codes = coded.indices.to_numpy()
            each = width[codes] if len(codes) else np.zeros(0, np.int64)
            first = (np.cumsum(width) - width)[codes] if len(codes) else np.zeros(0, np.int64)
            shift = np.repeat(first - (np.cumsum(each) - each), each)
            flat = pool.take(pa.array(shift + np.arange(len(shift))))
            ends = np.concatenate(([0], np.cumsum(each)))
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            bounds = ends[np.concatenate(([0], np.cumsum(counts)))]
            out = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)
            out = pc.if_else(lists.is_null(), pa.scalar(None, out.type), out)
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=[index, "pieces"])

    return df.select(index, tokens.alias(f"{index}_words")).mapInArrow(run, f"`{index}` {df.schema[index].dataType.simpleString()}, pieces array<string>")
