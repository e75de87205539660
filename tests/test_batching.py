import random

import numpy as np
import pytest

from seqloom.operators import batching


def fold(lengths, budget):
    out, number, count, longest = [], 0, 0, 0
    for x in lengths:
        wider = max(longest, x)
        if count and (count + 1) * wider > budget:
            number, count, wider = number + 1, 0, x
        count, longest = count + 1, wider
        out.append(number)
    return out


def random_lengths(rng, n):
    kind = rng.randrange(4)
    return [0 if kind == 3 and rng.random() < 0.6 else rng.choice([1, 1, 2, 3, 5, 8, 40]) if kind else rng.randrange(1, 30) for _ in range(n)]


def test_ends_and_chains_by_definition():
    rng = random.Random(1)
    for _ in range(200):
        x, budget = random_lengths(rng, rng.randrange(1, 40)), rng.choice([1, 10, 30, 100])
        ends = batching.batch_ends(np.array(x), budget)
        for i, e in enumerate(ends):
            batch = fold(x[i:], budget)
            assert e - i == batch.count(0)
        last, count = batching.chains(ends)
        for i in range(len(x)):
            at, n = i, 1
            while ends[at] < len(x):
                at, n = ends[at], n + 1
            assert (last[i], count[i]) == (at, n)


def test_ranges_agree_with_one_fold():
    """Any cuts into ranges: each is told only the state before it, found from the answers of the ranges."""
    rng = random.Random(2)
    for _ in range(400):
        x, budget = random_lengths(rng, rng.randrange(1, 80)), rng.choice([1, 10, 30, 100, 10_000])
        cuts = sorted({0, len(x), *(rng.randrange(len(x)) for _ in range(rng.randrange(12)))})
        state, out = batching.State(), []
        for a, b in zip(cuts, cuts[1:]):
            part = np.array(x[a:b])
            out += batching.numbers(part, state, budget).tolist()
            state = batching.carried(state, batching.summary(part, budget), budget)
        assert out == fold(x, budget), (x, budget, cuts)


def test_a_range_says_little():
    told = batching.summary(np.full(100_000, 64), 4096)
    assert max(map(len, told.values())) == 65


@pytest.mark.parametrize("width", [1, 7, 40])
def test_shards_over_ranges(spark, width):
    rng = random.Random(width)
    rows = []
    for shard, n in (("a", 1), ("b", 900), (None, 40), ("c", 0), ("d", 3), ("e", 300)):
        rows += [(shard, i, *(rng.choice([0, 1, 5, 20, 90, None]) for _ in range(2)), "x") for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, i long, a int, b int, _part string")
    got = batching.budget_batches(df, "s", "i", "a", "b", 200, width).collect()
    assert len(got) == len(rows) and all(r._part == "x" for r in got)
    for shard in {r[0] for r in rows}:
        mine = sorted((r for r in got if r.s == shard), key=lambda r: r.i)
        assert [r.batch_no for r in mine] == fold([max(r.a or 0, r.b or 0) for r in mine], 200)
    assert batching.budget_batches(df.limit(0), "s", "i", "a", "b", 200).count() == 0


def test_one_shard_is_cut_by_many_tasks(spark):
    df = spark.range(200_000).selectExpr("id", "0 AS s", "1 + pmod(xxhash64(id), 60) AS n")
    got = batching.budget_batches(df, "s", "id", "n", "n", 4096, 16).orderBy("id").select("n", "batch_no").toPandas()
    assert got.batch_no.tolist() == fold(got.n.tolist(), 4096)
