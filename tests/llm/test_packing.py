import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seqloom.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("capacity", [1, 2, 7, 60, 200])
def test_functions_are_dual_feasible(capacity):
    """The best that one sequence can hold, by a knapsack over all lengths, is worth no more than a whole one."""
    table, unit = packing.feasible(capacity)
    for row, u in zip(table, unit, strict=True):
        best = np.zeros(capacity + 1, np.int64)
        for c in range(1, capacity + 1):
            best[c] = max(best[c - 1], (row[1 : c + 1] + best[c - 1 :: -1][:c]).max())
        assert best[capacity] <= u and row.min() >= 0


def fewest(lengths, capacity):
    """By trying all placements."""
    best = len(lengths)

    def place(k, left):
        nonlocal best
        if len(left) >= best:
            return
        if k == len(lengths):
            best = len(left)
            return
        for s in {r: i for i, r in enumerate(left) if r >= lengths[k]}.values():
            left[s] -= lengths[k]
            place(k + 1, left)
            left[s] += lengths[k]
        place(k + 1, [*left, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_bounds_and_packings_against_all_placements():
    rng = random.Random(1)
    tight = 0
    for _ in range(300):
        capacity = rng.choice([10, 20, 50])
        x = np.array([rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))])
        low, true = packing.strongest(np.bincount(x, minlength=capacity + 1), capacity)[0], fewest(x.tolist(), capacity)
        sequence, offset, n = packing.best_fit(x, capacity)
        assert low <= true <= n
        tight += low == true
        for s in range(n):
            at = sorted((offset[k], x[k]) for k in np.flatnonzero(sequence == s))
            assert [o for o, _ in at] == [sum(y for _, y in at[:k]) for k in range(len(at))] and sum(y for _, y in at) <= capacity
        for row, unit in zip(*packing.feasible(capacity), strict=True):
            kept = packing.certified(x, sequence, n, row, int(unit), 0.999)
            assert len(kept) <= packing.strongest(np.bincount(x[np.isin(sequence, kept)], minlength=capacity + 1), capacity)[0]
    assert tight > 270


def test_each_piece_goes_to_the_fullest_sequence_with_room():
    sequence, _, n = packing.best_fit(np.array([5, 6, 3, 4, 2]), 10)
    assert n == 2 and sequence.tolist() == [1, 0, 1, 0, 1]


def check(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for at in held.values():
        at.sort()
        assert [o for o, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))] and sum(n for _, n in at) <= capacity
    return len(held)


@pytest.mark.parametrize("kind", ["small", "large", "halves", "long tail", "equal"])
def test_partitions_come_near_the_bound(spark, kind):
    rng = np.random.default_rng(2)
    n = 3000
    lengths = {"small": rng.integers(1, 400, n), "large": rng.integers(700, 2049, n), "halves": rng.integers(1000, 1050, n), "long tail": np.minimum(2048, rng.lognormal(5, 1.5, n).astype(int) + 1), "equal": np.full(n, 600)}[kind]
    df = spark.createDataFrame([(int(x), i, "a", 0) for i, x in enumerate(lengths)], "length long, item long, offset_ string, sequence int")
    low, alone = packing.lower_bound(df), packing.best_fit(lengths, 2048)[2]
    for width, task_pieces, more in ((None, packing.TASK_PIECES, 0), (8, packing.TASK_PIECES, 0.01), (None, 500, 0.012)):  # with few pieces a task, less fits together
        rows = packing.pack(df, 2048, width=width, task_pieces=task_pieces).collect()
        assert Counter(r.item for r in rows) == Counter(range(n)) and all(r.length == lengths[r.item] for r in rows)
        assert low <= check(rows, 2048) <= alone + 1 + more * alone if width or task_pieces < n else alone


def test_exchange_saves_sequences(spark):
    """Eight partitions of their own would leave eight sequences half empty."""
    df = spark.createDataFrame([(100,)] * 164, "length int")
    assert check(packing.pack(df, 2048, width=8).collect(), 2048) == 9 == packing.lower_bound(df)


def test_query_by_contract(spark):
    tokenizer = Tokenizer.from_file(PATH)
    rows = queries.op11_packing(spark, SF).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    lengths = []
    for d in docs:
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0]
        mine = sorted(by.pop(d.doc_id), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // 2048))) and [r.length for r in mine[1:]] == [2048] * (len(mine) - 1)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))] and sum(r.length for r in mine) == len(ids)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        lengths += [r.length for r in mine]
    assert not by
    assert check(rows, 2048) <= packing.strongest(np.bincount(lengths, minlength=2049), 2048)[0] + 1


def test_sequences_hold_the_ids_of_their_pieces(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["", None, "a b c", "word " * 500, "x", "x", "<|endoftext|> y", "tail "]
    df = spark.createDataFrame([(i if i != 4 else None, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    placed = packing.pack(packing.pieces_of(df, PATH, capacity=64, with_ids=True), 64)
    assert Counter(r.doc_id for r in placed.collect()) == {0: 1, 1: 1, 2: 1, 3: -(-501 // 64), None: 1, 5: 1, 6: 1, 7: 1}
    ids = sorted(i for r in packing.sequences(placed).collect() for i in r.ids)
    assert ids == sorted(i for t in texts for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    assert packing.pack(packing.pieces_of(df.limit(0), PATH), 2048).count() == 0
