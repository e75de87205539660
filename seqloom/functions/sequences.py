"""Dynamic programs over token sequences, and their Arrow functions.

Rows of the tables are vectors: what depends on the cell to the left is a running minimum or maximum, so a row is a few
numpy calls. Common subsequences use bit vectors in Python's long integers.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Tokens = Sequence[Hashable]


def _places(b: Tokens) -> dict[Hashable, int]:
    where: dict[Hashable, int] = {}
    for j, t in enumerate(b):
        where[t] = where.get(t, 0) | 1 << j
    return where


def _bit_rows(a: Tokens, where: dict[Hashable, int], full: int, v: int) -> Iterator[int]:
    """After each token of ``a`` a word whose zero bits mark where the subsequence with the other side grows; ``v`` is the word
    before."""
    for t in a:
        u = v & where.get(t, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def lcs(a: Tokens, b: Tokens) -> int:
    full = v = (1 << len(b)) - 1
    for v in _bit_rows(a, _places(b), full, full):  # one word is held, however long the sides are
        pass
    return len(b) - v.bit_count()


class _Rows:
    """The words of all prefixes of ``a``, of which one in about the square root of its length is kept: asked for from the end to
    the start, the words between two kept ones are computed again, once."""

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.where, self.full = a, _places(b), (1 << len(b)) - 1
        self.step = max(1, math.isqrt(len(a)))
        self.kept = [self.full]  # after 0, step, 2 * step, ... tokens
        for i, v in enumerate(_bit_rows(a, self.where, self.full, self.full), 1):
            if i % self.step == 0:
                self.kept.append(v)
        self.block, self.rows = -1, []

    def after(self, i: int) -> int:
        """The word after ``i`` tokens."""
        block, at = divmod(i, self.step)
        if block != self.block:
            start = block * self.step
            self.block, self.rows = block, [self.kept[block], *_bit_rows(self.a[start : start + self.step - 1], self.where, self.full, self.kept[block])]
        return self.rows[at]


def lcs_plan(a: Tokens, b: Tokens, prioritize_beginning: bool = False) -> tuple[list[bool], list[bool]]:
    """Which tokens of either side are kept by a longest common subsequence.

    Of several, the one found from the ends: equal tokens pair up, else a token of ``a`` is dropped where that costs nothing.
    """
    if prioritize_beginning:
        x, y = lcs_plan(a[::-1], b[::-1])
        return x[::-1], y[::-1]
    rows = _Rows(a, b)
    keep_a, keep_b = [False] * len(a), [False] * len(b)
    i, j = len(a), len(b)
    mask, here = rows.full, rows.after(i)
    length = here.bit_count()  # zero bits below j are the length, so one bits count as well
    while i and j:
        if a[i - 1] == b[j - 1]:  # then some longest one pairs these two
            i, j = i - 1, j - 1
            keep_a[i] = keep_b[j] = True
            mask >>= 1
            here = rows.after(i)
            length = (here & mask).bit_count()
        elif (above := ((before := rows.after(i - 1)) & mask).bit_count()) == length:
            i, here, length = i - 1, before, above
        else:
            j -= 1
            mask >>= 1
            length -= here >> j & 1
    return keep_a, keep_b


def unit_distance(a: Tokens, b: Tokens, swaps: bool) -> int:
    """Edits of cost 1, with or without adjacent transpositions, a column of the table at a time: bit j says whether a cell is above
    or below the one before it, and a few operations on long words make the next column's bits from the last one's."""
    if not a or not b:
        return max(len(a), len(b))
    where = _places(a)
    full = (1 << len(a)) - 1
    top = 1 << (len(a) - 1)
    up, down, diagonal, before, score = full, 0, 0, 0, len(a)
    for t in b:
        here = where.get(t, 0)
        crossed = ((full & ~diagonal & here) << 1) & before if swaps else 0
        diagonal = ((((here & up) + up) ^ up) | here | down | crossed) & full
        right, left = down | (full & ~(diagonal | up)), diagonal & up
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = (right << 1 | 1) & full, (left << 1) & full
        up, down = left | (full & ~(diagonal | right)), right & diagonal
        before = here
    return score


def edit_distance(a: Tokens, b: Tokens, insert: float = 1, remove: float = 1, replace: float = 1, swap: float | None = None) -> float:
    """Distance with own costs and, if ``swap`` is given, of adjacent transpositions (each token in one edit at most).

    An empty prefix is at distance of the other's length, whatever the costs.
    """
    if insert == remove == replace == 1 and swap in (None, 1):
        return unit_distance(a, b, swap == 1)
    codes: dict[Hashable, int] = {}
    x = np.array([codes.setdefault(t, len(codes)) for t in a], np.int64)
    y = np.array([codes.setdefault(t, len(codes)) for t in b], np.int64)
    steps = np.arange(len(y) + 1) * float(remove)
    before, row = None, np.arange(len(y) + 1, dtype=np.float64)
    for i, t in enumerate(x):
        best = np.minimum(row[1:] + insert, row[:-1] + (y != t) * replace)
        if swap is not None and i and len(y) > 1:
            crossed = (y[1:] == x[i - 1]) & (y[:-1] == t)
            best[1:] = np.where(crossed, np.minimum(best[1:], before[:-2] + swap), best[1:])
        before, row = row, np.minimum.accumulate(np.concatenate(([i + 1.0], best)) - steps) + steps
    out = float(row[-1])
    return int(out) if out.is_integer() else out


def similarity(a: str, b: str) -> float:
    """One minus the distance with swaps, by the longer length."""
    return 1.0 if a == b else 1.0 - edit_distance(a, b, swap=1) / max(len(a), len(b), 1)


#: Cells that one step of a batch of alignments works on: what numpy holds at once.
STEP_CELLS = 1 << 16


def alignment_scores(targets: Sequence[Tokens], hyps: Sequence[Tokens], copied: Sequence[Sequence[bool]], settings: Sequence[tuple[float, float]], normalize: bool = True) -> np.ndarray:
    """Scores of many hypotheses under many settings (rows by settings): alignments that earn less for copied tokens and pay for wrong ones.

    First tokens must align: an empty hypothesis scores minus infinity (unless nothing can be earned). Pairs of like lengths are worked
    on together. All pairs and settings of a batch are one array; target token i and hypothesis token j meet on anti-diagonal i + j,
    which depends on the two before it only, so a step is a few operations on whole diagonals.
    """
    out = np.empty((len(targets), len(settings)))
    if not len(targets) or not settings:
        return out
    n, m = np.array([len(t) for t in targets]), np.array([len(h) for h in hyps])
    reward, penalty = (np.array([s[k] for s in settings], np.float64)[:, None] for k in (0, 1))
    # Like lengths of targets, then of hypotheses: padding stays below a quarter or so of either side.
    kind = np.round(np.log(n + 8.0) * 4)
    order = np.lexsort((m, kind))
    at = 0
    while at < len(order):
        stop, low, rows = at + 1, order[at], n[order[at]]
        while stop < len(order) and kind[order[stop]] == kind[low] and m[order[stop]] <= m[low] * 1.25 + 8 and (stop - at) * len(settings) * rows < STEP_CELLS:
            stop += 1
        pick = order[at:stop]
        out[pick] = _aligned([targets[k] for k in pick], [hyps[k] for k in pick], [copied[k] for k in pick], n[pick], m[pick], reward, penalty)
        at = stop
    if not normalize:
        return out
    n_copied = np.array([sum(c) for c in copied])[:, None]
    most, least = n_copied * reward[:, 0] + (n[:, None] - n_copied), penalty[:, 0] * n_copied
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(most == least, 1.0, (out - least) / (most - least))


def _narrowest(reward: np.ndarray, penalty: np.ndarray, steps: int) -> tuple[type, int, float]:
    """The narrowest numbers that hold all sums exactly, what settings are multiplied by to be whole, and what stands for minus infinity:
    integers where settings are multiples of a small power of two, which narrow ones do several of at a time."""
    values = [float(v) for v in (*reward.ravel(), *penalty.ravel())]
    scale = max(v.as_integer_ratio()[1] for v in (*values, 1.0))
    if scale <= 1024:
        most = steps * scale * max(1.0, *map(abs, values))
        for kind, bits in ((np.int16, 15), (np.int32, 31)):
            if 4 * most < 1 << bits:
                return kind, scale, -(1 << (bits - 1))
    return np.float64, 1, -np.inf


def _aligned(targets: Sequence[Tokens], hyps: Sequence[Tokens], copied: Sequence[Sequence[bool]], n: np.ndarray, m: np.ndarray, reward: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The last cells of the tables of some pairs. Cell (i, j) is the best of the target without token i (nothing paid or earned), of
    hypothesis token j too many (paid for as token i says), and of both tokens aligned."""
    b, rows, columns = len(targets), int(n.max()), int(m.max())
    x, y, c = np.full((b, rows + 1), -1, np.int32), np.full((b, columns + 1), -2, np.int32), np.zeros((b, rows + 1), bool)
    for k, (t, h, known) in enumerate(zip(targets, hyps, copied, strict=True)):
        codes: dict[Hashable, int] = {}
        x[k, 1 : len(t) + 1] = [codes.setdefault(w, len(codes)) for w in t]
        y[k, 1 : len(h) + 1] = [codes.get(w, -2) for w in h]
        c[k, 1 : len(t) + 1] = known
    # By place in the target: (settings, pairs, rows + 1). Diagonal d holds cell (i, d - i) at i; cells off its ends are minus infinity.
    kind, scale, least = _narrowest(reward, penalty, rows + columns + 1)
    pay = np.where(c[None], penalty[:, :, None] * scale, 0.0).astype(kind)
    more = np.where(c[None], reward[:, :, None] * scale, 1.0 * scale).astype(kind) - pay
    before, last, now = (np.full(pay.shape, least, kind) for _ in range(3))
    last[:, :, 0] = 0  # cell (0, 0)
    found = np.full((len(reward), b), -np.inf)
    found[:, (n == 0) & (m == 0)] = 0.0
    y = np.ascontiguousarray(y[:, ::-1])
    for d in range(1, rows + columns + 1):
        lo, hi = max(1, d - columns), min(rows, d - 1) + 1
        cell = now[:, :, lo:hi]
        if hi > lo:
            np.multiply(x[:, lo:hi] == y[:, columns - d + lo : columns - d + hi], more[:, :, lo:hi], out=cell)
            cell += before[:, :, lo - 1 : hi - 1]
            np.maximum(cell, last[:, :, lo:hi], out=cell)
            cell += pay[:, :, lo:hi]
            np.maximum(cell, last[:, :, lo - 1 : hi - 1], out=cell)
        now[:, :, lo - 1] = least
        now[:, :, max(lo, hi) : max(lo, hi) + 1] = least
        done = np.flatnonzero(n + m == d)
        done = done[(n[done] >= lo) & (n[done] < hi)]
        if len(done):
            ends = now[:, done, n[done]]
            found[:, done] = np.where(ends < least / 2, -np.inf, ends / scale)
        before, last, now = last, now, before
    return found.T


def edit_scores(pairs: Sequence[tuple[str, str, str]], settings: Sequence[tuple[float, float]], normalize: bool = True) -> np.ndarray:
    """Scores of (source, target, hypothesis) texts, one for each (reward, penalty), over one plan a pair."""
    if any(r < 0 for r, _ in settings) or any(p > 0 for _, p in settings):
        raise ValueError("rewards are not negative, penalties not positive")
    split = [[x.split() for x in p] for p in pairs]
    copied = [lcs_plan(s, t, prioritize_beginning=True)[1] for s, t, _ in split]
    return alignment_scores([t for _, t, _ in split], [h for _, _, h in split], copied, settings, normalize)


def coloured(a: str, b: str) -> tuple[str, str]:
    """Both sides with kept tokens green and tokens unknown to the other side red."""
    s, t = a.split(), b.split()
    out = []
    for mine, other, kept in zip((s, t), (t, s), lcs_plan(s, t), strict=True):
        known = set(other)
        out.append(" ".join(f"\033[92m{x}\033[0m" if k else x if x in known else f"\033[91m{x}\033[0m" for x, k in zip(mine, kept, strict=True)))
    return out[0], out[1]


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two array columns; null if either is null."""
    return pd.Series([None if x is None or y is None else lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(T.DoubleType())
def string_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def edit_score_column(settings: Sequence[tuple[float, float]], normalize: bool = True):
    """An Arrow function from source, target and hypothesis texts to an array of scores; null if one of them is."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scores(src: pd.Series, tgt: pd.Series, hyp: pd.Series) -> pd.Series:
        rows = list(zip(src, tgt, hyp, strict=True))
        whole = [k for k, r in enumerate(rows) if None not in r]
        out: list = [None] * len(rows)
        for k, found in zip(whole, edit_scores([rows[k] for k in whole], settings, normalize).tolist(), strict=True):
            out[k] = found
        return pd.Series(out)

    return scores


@F.pandas_udf(T.StructType([T.StructField("a", T.ArrayType(T.BooleanType())), T.StructField("b", T.ArrayType(T.BooleanType()))]))
def lcs_plan_columns(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Null where either side is null."""
    plans = [(None, None) if x is None or y is None else lcs_plan(list(x), list(y)) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame({"a": [p for p, _ in plans], "b": [q for _, q in plans]})


def edit_distance_column(**costs):
    @F.pandas_udf(T.DoubleType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(edit_distance(x, y, **costs)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return distance
