"""Batches within a token budget, cut from one order of rows by many tasks.

A batch takes rows in order while rows times their longest side stay in budget. Where a batch ends depends on where it starts, and
so on all rows before it. Rows are dealt by range, and a range answers for itself what it would do with each batch that may reach
into it:

- A sparse table of maxima gives each row the end of the batch that would start there, by binary search over powers of two.
- Pointer doubling over these ends gives each row the last start of its chain inside the range, and how many starts there are.
- A batch that was begun before a range ends within the range's first rows, where the growing maximum of those rows alone fills the
  budget. So a range is told by that staircase, and by what becomes of a chain that enters at each of these rows.

The ranges' answers, a few rows each, are then followed in order, and every range numbers its own batches from the state it starts
with. A shard may be spread over any number of ranges, and a range may hold any number of shards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.corpus import ranged
from seqloom.sources.workspace import spare


def batch_ends(lengths: np.ndarray, budget: int) -> np.ndarray:
    """For each row the end of the batch that starts with it (the number of rows, if none of them ends it). A row above the budget is
    a batch of its own."""
    n = len(lengths)
    levels = [lengths]  # of each power of two the maximum of so many rows from each row on
    while 2 << (len(levels) - 1) <= n:
        half, below = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.maximum(below[:-half], below[half:]))
    start = np.arange(n)
    end, longest = start + 1, lengths.copy()
    for k in range(len(levels) - 1, -1, -1):
        size, level = 1 << k, levels[k]
        at = np.flatnonzero(end + size <= n)
        wider = np.maximum(longest[at], level[end[at]])
        fits = (end[at] + size - start[at]) * wider <= budget
        at = at[fits]
        end[at] += size
        longest[at] = wider[fits]
    return end


def chains(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the last start of the chain of batches from it, and how many starts the chain has, itself included."""
    n = len(ends)
    last = np.where(ends < n, ends, np.arange(n))
    steps = (ends < n).astype(np.int64)
    while True:
        further = last[last]
        if np.array_equal(further, last):
            return last, steps + 1
        steps += steps[last]
        last = further


@dataclass
class State:
    """An open batch: its number, rows and longest side so far."""

    number: int = 0
    count: int = 0
    longest: int = 0


def entry(state: State, longest: np.ndarray, budget: int) -> int:
    """How many rows the open batch takes of rows whose maxima so far are ``longest`` (all, if they don't end it)."""
    if not state.count:
        return 0
    over = (state.count + np.arange(1, len(longest) + 1)) * np.maximum(longest, state.longest) > budget
    return int(np.argmax(over)) if over.any() else len(longest)


def reach(longest: np.ndarray, budget: int) -> int:
    """The rows within which every batch begun before them has ended."""
    over = np.arange(1, len(longest) + 1) * longest > budget
    return int(np.argmax(over)) + 1 if over.any() else len(longest)


def summary(lengths: np.ndarray, budget: int) -> dict[str, list[int]]:
    """What a range says of the rows of a shard that goes on behind it: their maxima within reach, and for each place at which a chain
    may enter, how many batches it starts, and the rows and longest side of the last one."""
    longest = np.maximum.accumulate(lengths)
    near = reach(longest, budget)
    last, starts = chains(batch_ends(lengths, budget))
    back = np.maximum.accumulate(lengths[::-1])[::-1]
    at = last[:near]
    return {"longest": longest[:near].tolist(), "starts": starts[:near].tolist(), "rows": (len(lengths) - at).tolist(), "side": back[at].tolist(), "total": [len(lengths), int(longest[-1])]}


def carried(state: State, told: dict[str, list[int]], budget: int) -> State:
    """The open batch behind a range, from the one before it."""
    rows, side = told["total"]
    at = entry(state, np.array(told["longest"], np.int64), budget)
    if at == rows:
        return State(state.number, state.count + rows, max(state.longest, side))
    first = state.number + 1 if state.count else 0
    return State(first + told["starts"][at] - 1, told["rows"][at], told["side"][at])


def numbers(lengths: np.ndarray, state: State, budget: int) -> np.ndarray:
    """The batch of each row, given the open batch before them."""
    out = np.full(len(lengths), state.number, np.int64)
    at = entry(state, np.maximum.accumulate(lengths), budget)
    if at < len(lengths):
        ends = batch_ends(lengths, budget)
        starts = np.zeros(len(lengths), np.int64)
        while at < len(lengths):
            starts[at] = 1
            at = int(ends[at])
        out += np.cumsum(starts) - (0 if state.count else 1)
    return out


def budget_batches(df: DataFrame, shard: str, order: str, src_len: str, tgt_len: str, budget: int, width: int | None = None) -> DataFrame:
    """Adds ``batch_no``: within each shard, in order, rows join the batch while rows times longest side stay in budget.

    A row above the budget is a batch of its own; a null length counts as 0. Rows equal in shard and order get some order. Shards are
    spread over ranges, whatever their size.
    """
    part, place, length = spare(df, "part", "place", "length")
    rows = ranged(df, [F.col(shard), F.col(order)], part, place, width)
    longer = F.greatest(F.coalesce(F.col(src_len).cast("long"), F.lit(0)), F.coalesce(F.col(tgt_len).cast("long"), F.lit(0)), F.lit(0).cast("long"))
    rows = rows.withColumn(length, longer)
    # Of each range its first and its last shard: only they reach over its bounds.
    segments = rows.groupBy(part, shard).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    by_part = Window.partitionBy(part)
    edges = segments.withColumn("low", F.min("first").over(by_part) == F.col("first")).withColumn("high", F.max("last").over(by_part) == F.col("last")).where("low OR high")
    cut = [(r[part], r[shard], r.low, r.high) for r in edges.collect()]  # two rows a range
    cut.sort(key=lambda r: (r[0], not r[2]))
    ends_open, goes_on = set(), set()  # ranges whose last shard goes on behind them; ranges whose first shard was begun before
    lasts = [(p, s) for p, s, _, high in cut if high]
    firsts = {p: s for p, s, low, _ in cut if low}
    for (p, s), (q, _) in zip(lasts, lasts[1:], strict=False):
        if firsts[q] == s:
            ends_open.add(p)
            goes_on.add(q)
    single = {p for p, _, low, high in cut if low and high}
    entering = _entering(rows, part, place, length, shard, sorted(ends_open | goes_on), dict(lasts), ends_open, goes_on, single, budget)
    return _numbered(df, rows, shard, part, place, length, entering, budget)


def _entering(rows: DataFrame, part: str, place: str, length: str, shard: str, wanted: list[int], last: dict, ends_open: set, goes_on: set, single: set, budget: int) -> dict[int, State]:
    """The open batch with which each range starts, if its first shard was begun before."""
    if not wanted:
        return {}

    def tell(table: pa.Table) -> pa.Table:
        table = table.sort_by(place)
        mine = table.column(shard).combine_chunks()
        changed = np.flatnonzero(_changes(mine))
        lengths = table.column(length).to_numpy().astype(np.int64)
        told = summary(lengths[changed[-1] if len(changed) else 0 :], budget)  # the last shard's rows
        return pa.table({part: pa.array([table.column(part)[0].as_py()], pa.int32()), **{k: pa.array([v], pa.list_(pa.int64())) for k, v in told.items()}})

    schema = f"`{part}` int, " + ", ".join(f"{k} array<long>" for k in ("longest", "starts", "rows", "side", "total"))
    open_rows = rows.where(F.col(part).isin(sorted(ends_open))).select(part, place, shard, length)
    told = {r[part]: r.asDict() for r in open_rows.groupBy(part).applyInArrow(tell, schema).collect()}
    found, state = {}, State()
    order = sorted(last)
    for p in order:
        if p in goes_on:
            found[p] = state
        if p in ends_open:
            state = carried(state if p in goes_on and p in single else State(), told[p], budget)
        else:
            state = State()
    return found


def _changes(values: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it (nulls are equal)."""
    codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate(([False], codes[1:] != codes[:-1]))


def _numbered(df: DataFrame, rows: DataFrame, shard: str, part: str, place: str, length: str, entering: dict[int, State], budget: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast({p: (s.number, s.count, s.longest) for p, s in entering.items()})  # a row a range
    columns = df.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(place)
        lengths = table.column(length).to_numpy().astype(np.int64)
        cuts = [0, *np.flatnonzero(_changes(table.column(shard).combine_chunks())).tolist(), len(lengths)]
        state = State(*shared.value.get(table.column(part)[0].as_py(), (0, 0, 0)))
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            out.append(numbers(lengths[a:b], state, budget))
            state = State()
        return table.select(columns).append_column("batch_no", pa.array(np.concatenate(out)))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "batch_no long"])
    return rows.groupBy(part).applyInArrow(run, schema)
