"""What each of several filters removes, in every order of applying them.

Texts are scanned in their Arrow buffers: a table of byte classes, prefix sums over them, and sums between the documents' bounds
count words, capitals, symbols and code points. Words are hashed by differences of prefix sums, sorted inside their document, and
neighbours with equal hashes are compared byte by byte; a document in which unequal words share a hash is counted by a set. Each
document becomes a mask of the filters that it fails; orders are evaluated on counts of masks, never on documents.

    A  fewer than ``least_words`` words          C  capitals above ``most_capitals`` hundredths of the code points
    B  distinct words below ``least_distinct``   D  a character of ``#$%&*|``
       hundredths of the words                   E  the text of a document with a smaller id

Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.

Defined results: null text counts as empty, null source as ''; rows with a null id fail E for no other row and never fail it
themselves; of repeated rows (same id, same text) each counts and none fails E for the others; a document counts as good or toxic
if one of its labels says so, and labels of unknown documents or without an id are ignored; without documents there are no parts;
columns other than those asked for are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
WORD, CAPITAL, SYMBOL, LEAD = 1, 2, 4, 8
#: Bytes and texts scanned at once (one longer text is scanned alone): what numpy makes of them stays in a core's cache.
SLICE_BYTES, SLICE_ROWS = 1 << 18, 1 << 15
#: Odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15


def byte_classes() -> np.ndarray:
    """The classes of each byte value as bits."""
    kinds = np.full(256, WORD | LEAD, np.uint8)
    kinds[[0x20, *range(0x09, 0x0E)]] = LEAD
    kinds[0x80:0xC0] = WORD  # inside a code point
    kinds[ord("A") : ord("Z") + 1] |= CAPITAL
    kinds[list(b"#$%&*|")] |= SYMBOL
    return kinds


def powers(base: int, count: int) -> np.ndarray:
    """``base ** 0, base ** 1, ...`` modulo 2 ** 64."""
    out = np.ones(count, np.uint64)
    done = 1
    while done < count:
        step = np.uint64(pow(base, done, 1 << 64))
        out[done : 2 * done] = out[: min(done, count - done)] * step
        done *= 2
    return out


def eight_bytes(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer (``padded`` has eight bytes more than texts)."""
    window = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    return window[at].view("<u8").ravel()


def equal_words(data: np.ndarray, padded: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the words of ``length`` bytes at ``a`` and ``b`` have the same bytes."""
    same, open_, at = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(open_) and at < 64:
        left = length[open_] - at
        shift = (8 * (8 - np.clip(left, 0, 8))).astype(np.uint64)
        x = eight_bytes(padded, a[open_] + at) ^ eight_bytes(padded, b[open_] + at)
        equal = (x << np.minimum(shift, np.uint64(63)) == 0) | (shift == 64)
        same[open_[~equal]] = False
        open_ = open_[equal & (left > 8)]
        at += 8
    for k in open_:  # words of more than 64 bytes
        same[k] = np.array_equal(data[a[k] + at : a[k] + length[k]], data[b[k] + at : b[k] + length[k]])
    return same


class Scanner:
    """Counts of a slice of texts: ``words, distinct, capitals, symbols, chars``."""

    def __init__(self, base: int = BASE):
        self.kinds, self.base, self.inverse = byte_classes(), base, pow(base, -1, 1 << 64)
        self.values = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = self.back = np.ones(1, np.uint64)
        kinds = np.arange(16)
        self.pair = (kinds & CAPITAL != 0) + ((kinds & SYMBOL != 0).astype(np.int64) << 32)
        self.lead = (kinds & LEAD != 0).astype(np.int64)

    def _grown(self, size: int) -> None:
        if len(self.power) < size:
            self.power, self.back = powers(self.base, size), powers(self.inverse, size)

    def hashes(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        self._grown(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.values[data] * self.power[: len(data)], dtype=np.uint64)))
        return (sums[stop] - sums[start]) * self.back[start]

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the texts ``data[bounds[k] : bounds[k + 1]]``."""
        kinds, n = self.kinds[data], len(bounds) - 1
        word = (kinds & WORD) != 0
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        at, to = bounds[full], bounds[full + 1] - 1
        first[at], last[to] = word[at], word[to]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        # Two counts fit into one prefix sum: a text has less than 2 ** 31 bytes.
        capitals, symbols = self._totals(self.pair[kinds], bounds)
        chars, words = self._totals(self.lead[kinds] + (first.astype(np.int64) << 32), bounds)
        length, text = stop - start, np.repeat(np.arange(n), words)
        hashed = self.hashes(data, start, stop) + length.astype(np.uint64)
        # Sorted by text, then by 48 bits of the hash.
        order = np.argsort((text.astype(np.uint64) << np.uint64(48)) | (hashed >> np.uint64(16)))
        a, b = order[:-1], order[1:]
        near = (text[a] == text[b]) & (hashed[a] == hashed[b])
        a, b = a[near], b[near]
        padded = np.concatenate((data, np.zeros(72, np.uint8)))
        same = (length[a] == length[b]) & equal_words(data, padded, start[a], start[b], np.minimum(length[a], length[b]))
        distinct = words - np.bincount(text[b], minlength=n)
        # Unequal words with one hash, or with hashes that differ below the bits sorted by: such a text is counted by a set.
        split = text[order[:-1]] == text[order[1:]]
        split &= (hashed[order[:-1]] >> np.uint64(16) == hashed[order[1:]] >> np.uint64(16)) & ~near
        for k in np.unique(np.concatenate((text[b[~same]], text[order[1:][split]]))):
            distinct[k] = len(set(data[bounds[k] : bounds[k + 1]].tobytes().split()))
        return words, distinct, capitals, symbols, chars

    @staticmethod
    def _totals(each: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(each)))[bounds])
        return total & 0xFFFFFFFF, total >> 32


def counts_of(texts: pa.Array, scanner: Scanner) -> list[np.ndarray]:
    """The scanner's counts for an Arrow array of texts, slice by slice."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return [np.zeros(0, np.int64)] * 5
    _, offsets, raw = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    out, at = [], 0
    while at < len(texts):
        stop = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1), at + SLICE_ROWS)
        bounds = offsets[at : stop + 1] - offsets[at]
        out.append(scanner(raw[offsets[at] : offsets[stop]], bounds))
        at = stop
    return [np.concatenate(x) for x in zip(*out, strict=True)]


NAMES = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars")


def scanned(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` without their text, with its five counts (``NAMES``) in its place."""
    at = rows.columns.index(text)
    kept = [f for f in rows.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            found = [pa.array(x, pa.int64()) for x in counts_of(b.column(at), scanner)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns) if k != at), *found], names=[*(f.name for f in kept), *NAMES])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} long" for n in NAMES)]))


def own_failures(least_words: int, least_distinct: int, most_capitals: int) -> Column:
    """The filters among A to D that a scanned row fails, as bits."""
    tests = (F.col("n_words") < least_words, 100 * F.col("n_distinct") < least_distinct * F.col("n_words"), 100 * F.col("n_capitals") > most_capitals * F.col("n_chars"), F.col("n_symbols") > 0)
    return sum((F.when(t, F.lit(1 << k)).otherwise(F.lit(0)) for k, t in enumerate(tests)), F.lit(0)).cast("int")


def masks(docs: DataFrame, labels: DataFrame, *, least_words: int = 200, least_distinct: int = 50, most_capitals: int = 2) -> DataFrame:
    """``part, fails, n, good, toxic``: how many documents of a part fail just the filters in the mask ``fails``, and how many of
    them are labelled good or toxic.

    Equal texts fail the same of A to D, so only counts and least ids of equal texts meet, combined before they are shuffled: a
    text that a third of all rows share is a few rows a task. Rows without an id are spread by their text.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("same"), F.col("text").alias("text"))
    rows = scanned(picked, "text").select("doc_id", "part", "same", own_failures(least_words, least_distinct, most_capitals).alias("fails"))
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("same")).otherwise(F.lit(0)))
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").eqNullSafe(1).alias("good"), F.col("toxic").eqNullSafe(1).alias("toxic")).where("doc_id IS NOT NULL AND (good OR toxic)")
    said = said.groupBy("doc_id", F.lit(0).cast("long").alias("spread")).agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    known = rows.join(said, ["doc_id", "spread"], "left").na.fill(False, ["good", "toxic"])
    each = known.groupBy("doc_id", "spread", "same", "part", "fails", "good", "toxic").agg(F.count("*").alias("n"))
    numbered = F.col("doc_id").isNotNull()
    alike = each.groupBy("same", "part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(~numbered, F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(numbered, F.struct("doc_id", "n"))).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("same"))  # a row a part and label
    counted = alike.withColumn("stay", F.col("nameless") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(F.lit(0)))
    e = 1 << FILTERS.index("E")
    cells = counted.select("part", "good", "toxic", F.inline(F.array(F.struct("fails", F.col("stay").alias("n")), F.struct((F.col("fails") + e).alias("fails"), (F.col("n") - F.col("stay")).alias("n")))))
    n = F.col("n")
    return cells.where("n > 0").groupBy("part", "fails").agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def orders(filters: str = FILTERS) -> Column:
    """All orders and their steps as an array: the step's filter, and the filters before it, as bits."""
    bit = {f: 1 << FILTERS.index(f) for f in filters}
    steps = [{"filter_order": o, "step": k + 1, "bit": bit[f], "before": sum(bit[x] for x in o[:k])} for o in map("".join, permutations(filters)) for k, f in enumerate(o)]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")


def audit(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """``part, filter_order, step`` and the counts ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    A part's masks are at most 32 rows, whatever its size; the orders are laid out beside them.
    """
    parts = masks(docs, labels, **limits).groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    each = parts.select("part", "cells", F.inline(orders()))
    bit, before = F.col("bit"), F.col("before")
    n_orders = len(list(permutations(FILTERS)))

    def added(test, value=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", test), F.lit(0).cast("long"), lambda total, c: total + value(c))

    fails = lambda c: c["fails"].bitwiseAND(bit) != 0
    met = lambda c: c["fails"].bitwiseAND(before) == 0
    removed = lambda c: fails(c) & met(c)
    return each.select(
        "part", "filter_order", "step",
        added(lambda c: ~fails(c) & met(c)).alias("kept"), added(removed).alias("removed"), added(lambda c: fails(c) & ~met(c)).alias("redundant"),
        added(lambda c: c["fails"] == bit).alias("unique_fails"), added(removed, lambda c: c["good"]).alias("good_lost"), added(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        # A document goes by each filter that it fails in equally many orders.
        added(fails, lambda c: c["n"] * F.floor(F.lit(n_orders) / F.bit_count(c["fails"]))).alias("shapley"),
    )
