"""Runs: maximal stretches of words that repeat with a period, found from Lyndon words.

The longest Lyndon word from each place is found by a stack scanned from right to left, once under an order of the words and
once under its reverse; a run's root is such a word under one of the two. A root that is followed by its own repetition is
extended to both sides. Suffixes are compared, and runs extended, by the length of their common extension: a binary search over
rolling hashes, and what it finds equal is compared word by word, so no hash decides alone. There is no suffix array.

Comparisons at one distance, from right to left, go on from what the last one at that distance found, so a text that repeats
all through is compared word by word about once.

A document without any eight words in a row that come again in it can't have a run of 24 words of three periods; its stack isn't
scanned.

Defined results: null text counts as empty and has no runs; texts of any length are worked on whole, a document at a time, in
memory that grows with its words; equal texts get equal results; rows without an id are as any other; no rows, no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least this many words, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Odd, so every power has an inverse modulo 2 ** 64.
BASE = 0xD1342543DE82EF95
SLICE = 256


@dataclass(frozen=True, order=True)
class Run:
    start: int
    period: int
    length: int


class Extensions:
    """Common extensions of places in a sequence of codes."""

    def __init__(self, codes: np.ndarray, base: int = BASE):
        self.codes, self.list, self.n = codes, codes.tolist(), len(codes)
        values = np.random.default_rng(9).integers(1, 1 << 63, int(codes.max(initial=0)) + 1, dtype=np.uint64)
        self.power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(self.n, base, np.uint64))), dtype=np.uint64)
        # The hash of [i, j) is sums[j] - sums[i]; of two stretches the left one's is multiplied up to the right one's place.
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[codes] * self.power[: self.n], dtype=np.uint64)))
        self._sums, self._power = self.sums.tolist(), self.power.tolist()

    def alike(self, i: int, j: int, size: int) -> bool:
        """Whether the hashes of ``size`` words from ``i`` and from ``j > i`` on are equal."""
        s = self._sums
        return not ((s[i + size] - s[i]) * self._power[j - i] - s[j + size] + s[j]) & 0xFFFFFFFFFFFFFFFF

    @staticmethod
    def _search(most: int, alike: Callable[[int], bool]) -> int:
        """The largest size up to ``most`` that is alike, if those below it are: doubling, then halving."""
        step = 1
        while step <= most and alike(step):
            step *= 2
        low, high = step // 2, min(step, most + 1)
        while high - low > 1:
            mid = (low + high) // 2
            if alike(mid):
                low = mid
            else:
                high = mid
        return low

    def ahead(self, i: int, j: int, most: int | None = None) -> int:
        """How many words from ``i`` and from ``j > i`` on are equal, up to ``most``."""
        most = self.n - j if most is None else min(most, self.n - j)
        found = self._search(most, lambda size: self.alike(i, j, size))
        if self.list[i : i + found] == self.list[j : j + found]:
            return found
        return int(np.argmax(self.codes[i : i + found] != self.codes[j : j + found]))

    def back(self, i: int, j: int) -> int:
        """How many words before ``i`` and before ``j > i`` are equal."""
        found = self._search(i, lambda size: self.alike(i - size, j - size, size))
        if self.list[i - found : i] == self.list[j - found : j]:
            return found
        return int(np.argmax(self.codes[i - found : i][::-1] != self.codes[j - found : j][::-1]))


def longest_lyndon(codes: list[int], ext: Extensions) -> np.ndarray:
    """For each place the first one after it whose suffix is smaller (a proper prefix is): the longest Lyndon word ends there."""
    n = len(codes)
    after = [n] * n
    met: dict[int, tuple[int, int]] = {}  # at each distance the leftmost place compared, and its extension
    for i in range(n - 2, -1, -1):
        j, word = i + 1, codes[i]
        while j < n:
            other = codes[j]
            if word == other:
                if j + 1 < n and codes[i + 1] != codes[j + 1]:
                    size = 1
                else:
                    place, known = met.get(j - i, (n, 0))
                    gap = place - i
                    size = 1 if gap == 1 else ext.ahead(i, j, gap)
                    if size == gap:
                        size += known
                met[j - i] = (i, size)
                if j + size == n or codes[j + size] < codes[i + size]:
                    break  # the later suffix is smaller, or a prefix of this one
            elif other < word:
                break
            j = after[j]
        after[i] = j
    return np.array(after, np.int64)


def runs(words: Sequence, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[Run]:
    """All runs of at least ``least_words`` words and ``least_periods`` (2 or more) periods, by start, then period."""
    known: dict = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    n = len(codes)
    if n < least_words:
        return []
    ext, found = Extensions(codes), set()
    for order in (codes, codes.max() - codes):
        place = np.arange(n)
        period = longest_lyndon(order.tolist(), ext) - place
        # A run of three periods holds a root with its repetition behind it; of two, a root with what is left of it before and behind.
        room = place + 2 * period <= n if least_periods >= 3 else np.ones(n, bool)
        i, p = place[room], period[room]
        if least_periods >= 3:
            square = (ext.sums[i + p] - ext.sums[i]) * ext.power[p] == ext.sums[i + 2 * p] - ext.sums[i + p]
            i, p = i[square], p[square]
        covered: dict[int, int] = {}  # of each period, where the run found last ends
        for a, q in zip(i.tolist(), p.tolist(), strict=True):
            if covered.get(q, -1) >= a + 2 * q:
                continue  # a later root of the same run
            right = ext.ahead(a, a + q) if a + q < n else 0
            left = ext.back(a, a + q) if a + q <= n else 0
            length = left + q + right
            if length >= least_periods * q:
                covered[q] = a + q + right
                if length >= least_words:
                    found.add(Run(a - left, q, length))
    return sorted(found)


def repeated(words: Sequence, size: int = 8) -> bool:
    """Whether some ``size`` words in a row may come twice (equal ones always do, by their hashes)."""
    n = len(words) - size + 1
    if n < 2:
        return False
    each = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(BASE) + each[k : k + n]
    total.sort()
    return bool((total[1:] == total[:-1]).any())


def document_runs(words: Sequence) -> list[Run]:
    """``runs`` with the default bounds. A run of 24 words and of three periods repeats all but its first period: 16 words at least,
    where the period is up to 8, and else two periods; so eight words in a row come twice."""
    return runs(words) if repeated(words) else []


def best(found: list[Run]) -> Run | None:
    """The run with the greatest length by period; of equal ones the first, then the one of the least period."""
    out = None
    for r in found:
        if out is None or r.length * out.period > out.length * r.period:
            out = r
    return out


def collapsed(words: Sequence, found: list[Run]) -> list:
    """The words that no run holds behind its first period."""
    if not found:
        return list(words)
    change = np.zeros(len(words) + 1, np.int64)
    for r in found:
        change[r.start + r.period] += 1
        change[r.start + r.length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def planted(words: list, doc_id: int | None) -> list:
    """The registered query's texts: of one document in ten, chosen by its id, the words from some place on are made to repeat."""
    from zlib import crc32

    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def per_document(docs: DataFrame, change: Callable[[list, int | None], list] | None = None) -> DataFrame:
    """``doc_id, runs, kept``: a document's runs, and its words without what repeats (joined by one space), of its text or of what ``change`` makes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                found, kept = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                    words = (t or b"").split()  # at the six ASCII blanks
                    if change:
                        words = change(words, i)
                    mine = document_runs(words)
                    found.append([{"start": r.start, "length": r.length, "period": r.period} for r in mine])
                    kept.append(b" ".join(collapsed(words, mine)).decode())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind), pa.array(kept, pa.string())], names=["doc_id", "runs", "kept"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return picked.mapInArrow(run, "doc_id long, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept string")


def digests(found: DataFrame) -> DataFrame:
    """Of ``per_document``: the number of runs, the best run's figures, and digests of all runs and of the kept words.

    The best of runs is chosen by products of integers, as in ``best``.
    """
    better = lambda x, y: F.when(x.isNull() | (y["length"] * x["period"] > x["length"] * y["period"]), y).otherwise(x)
    top = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    rows = found.select("doc_id", "runs", "kept", top.alias("top"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )
