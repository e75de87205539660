import functools
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.functions import sequences as q
from seqloom.functions.assignment import assign

A, B = "a a b c d e".split(), "a b c d f e".split()
TOKENS = st.lists(st.sampled_from("abcd"), max_size=9)


def common(a, b):
    """The longest common subsequence by its definition: over all subsequences of the shorter side."""
    short, long = sorted((list(a), list(b)), key=len)

    def within(sub):
        rest = iter(long)
        return all(x in rest for x in sub)

    return next(n for n in range(len(short), -1, -1) if any(within(sub) for sub in itertools.combinations(short, n)))


def recursive_distance(a, b, insert, remove, replace, swap):
    """By the last edit; a side of which nothing is left costs the other's length."""

    @functools.cache
    def to(i, j):
        if not (i and j):
            return float(i + j)
        same, crossed = a[i - 1] == b[j - 1], swap is not None and a[max(i - 2, 0) : i] == b[max(j - 2, 0) : j][::-1] and min(i, j) > 1
        ways = {to(i - 1, j - 1) + replace * (not same), to(i - 1, j) + insert, to(i, j - 1) + remove}
        return min(ways | {to(i - 2, j - 2) + swap} if crossed else ways)

    return to(len(a), len(b))


def recursive_score(tgt, hyp, copied, reward, penalty):
    """What the rest of both sides can earn at best, once their first tokens are aligned."""

    @functools.cache
    def best(i, j):
        if not (i and j):
            return 0.0 if i == j else -np.inf
        earn, pay = (reward, penalty) if copied[i - 1] else (1.0, 0.0)
        return max(best(i - 1, j - 1) + (earn if tgt[i - 1] == hyp[j - 1] else pay), best(i, j - 1) + pay, best(i - 1, j))

    return best(len(tgt), len(hyp))


def test_fixed_values():
    assert q.lcs(A, B) == 5
    bits = lambda s: [c == "1" for c in s.split()]
    assert q.lcs_plan(A, B) == (bits("0 1 1 1 1 1"), bits("1 1 1 1 0 1"))
    assert q.lcs_plan(A, B, prioritize_beginning=True) == (bits("1 0 1 1 1 1"), bits("1 1 1 1 0 1"))
    for a, b, with_swap, without in (("ca", "ac", 1, 2), ("ca", "abc", 3, 3), ("count", "cuont", 1, 2)):
        assert (q.edit_distance(a, b, swap=1), q.edit_distance(a, b)) == (with_swap, without)
    assert q.similarity("", "") == 1.0
    assert q.similarity("kitten", "sitting") == pytest.approx(0.571429, abs=1e-6)
    assert q.similarity("int", "unsigned int") == pytest.approx(0.25)
    settings_ = [(0.0, 0.0), (0.5, 0.0), (0.0, -0.5)]
    for src, tgt, hyp, want in (("a b c", "a x c", "a x c", (1, 1, 1)), ("a b c", "a x c", "a b c", (0, 0.5, 0.5)), ("a b", "a b", "a b", (1, 1, 1)), ("a b", "a b", "z", (1, 0, 0.5))):
        assert q.edit_scores([(src, tgt, hyp)], settings_)[0] == pytest.approx(list(want))
    assert q.edit_scores([("a", "b", "")], [(0.0, 0.0)])[0, 0] == -np.inf
    for bad in ((-1.0, 0.0), (0.0, 1.0)):
        with pytest.raises(ValueError):
            q.edit_scores([("a", "a", "a")], [bad])
    assert q.coloured("a b", "a c") == ("\033[92ma\033[0m \033[91mb\033[0m", "\033[92ma\033[0m \033[91mc\033[0m")


@settings(max_examples=300, deadline=None)
@given(TOKENS, TOKENS)
def test_subsequences(a, b):
    n = common(a, b)
    assert q.lcs(a, b) == q.lcs(b, a) == n <= min(len(a), len(b))
    for first in (False, True):
        x, y = q.lcs_plan(a, b, first)
        assert sum(x) == sum(y) == n
        assert [t for t, k in zip(a, x, strict=True) if k] == [t for t, k in zip(b, y, strict=True) if k]


@settings(max_examples=200, deadline=None)
@given(TOKENS, TOKENS, st.sampled_from([(1, 1, 1, None), (1, 1, 1, 1), (2.0, 1.5, 2.5, 0.5), (0.5, 3.0, 1.0, None)]))
def test_distances(a, b, costs):
    got = q.edit_distance(a, b, *costs)
    assert got == pytest.approx(recursive_distance(a, b, *costs))
    if costs == (1, 1, 1, 1):
        assert got == q.edit_distance(b, a, swap=1) and (got == 0) == (a == b)


@settings(max_examples=200, deadline=None)
@given(TOKENS, TOKENS, st.lists(st.booleans(), min_size=9, max_size=9), st.sampled_from([(0.0, 0.0), (0.5, 0.0), (0.0, -0.5), (0.3, -1.0)]))
def test_edit_scores(tgt, hyp, copied, setting):
    got, want = q.alignment_scores([tgt], [hyp], [copied[: len(tgt)]], [setting], normalize=False)[0, 0], recursive_score(tgt, hyp, copied, *setting)
    assert got == want or got == pytest.approx(want)


@pytest.mark.parametrize("cells", [1, 1 << 16])
def test_edit_scores_of_a_batch(monkeypatch, cells):
    """Pairs of all lengths at once, under all settings, have the scores that each has alone."""
    monkeypatch.setattr(q, "STEP_CELLS", cells)
    rng = random.Random(8)
    side = lambda: [rng.choice("abcd") for _ in range(rng.choice([0, 1, 3, 8, 20]))]
    tgts, hyps = [side() for _ in range(200)], [side() for _ in range(200)]
    copied = [[rng.random() < 0.5 for _ in t] for t in tgts]
    settings_ = [(0.0, 0.0), (0.5, 0.0), (0.0, -0.5), (0.3, -1.0)]
    got = q.alignment_scores(tgts, hyps, copied, settings_, normalize=False)
    for k, (t, h, c) in enumerate(zip(tgts, hyps, copied)):
        for s, setting in enumerate(settings_):
            assert got[k, s] == pytest.approx(recursive_score(t, h, c, *setting))
    assert q.alignment_scores([], [], [], settings_).shape == (0, 4)


def test_unit_distances_of_long_texts():
    """Words of many bits against the table."""
    rng = random.Random(9)
    for n in (0, 1, 63, 64, 65, 200):
        for _ in range(20):
            a = [rng.choice("ab" if n % 2 else "abcdefgh") for _ in range(n)]
            b = [x for x in a if rng.random() < 0.9]
            for _ in range(n // 20):
                k = rng.randrange(max(1, len(b) - 1))
                b[k : k + 2] = b[k : k + 2][::-1]
            for swap in (None, 1):
                # Nearly equal costs take the other way.
                assert abs(q.edit_distance(a, b, swap=swap) - q.edit_distance(a, b, 1, 1.0000000001, 1, swap)) < 1e-6


def test_assignment():
    rng = random.Random(0)
    for _ in range(150):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        c = np.array([[rng.choice([rng.random(), 0.5]) for _ in range(m)] for _ in range(n)])
        rows, columns = assign(c)
        pairs = [(i, j) for i, j in enumerate(rows) if j is not None]
        assert len(pairs) == min(n, m) and pairs == sorted((i, j) for j, i in enumerate(columns) if i is not None)
        small, large = (c, range(m)) if n <= m else (c.T, range(n))
        best = min(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(large, min(n, m)))
        assert sum(c[i, j] for i, j in pairs) == pytest.approx(best)


def test_columns(spark):
    df = spark.createDataFrame([(A, B, "ca", "abc"), (None, B, None, "x"), ([], [], "", "")], "a array<string>, b array<string>, s string, t string")
    assert [r[0] for r in df.select(q.lcs_length("a", "b")).collect()] == [5, None, 0]
    plans = [r[0] for r in df.select(q.lcs_plan_columns("a", "b")).collect()]
    assert [plans[0].a, plans[0].b] == list(q.lcs_plan(A, B)) and plans[1] == (None, None) and plans[2] == ([], [])
    texts = spark.createDataFrame([("a b c", "a x c", "a b c"), (None, "a", "a"), ("a", "b", "")], "s string, t string, h string")
    assert [r[0] for r in texts.select(q.edit_score_column([(0.0, 0.0), (0.5, 0.0)])("s", "t", "h")).collect()] == [[0.0, 0.5], None, [-np.inf, -np.inf]]
    assert [r[0] for r in df.select(q.string_similarity("s", "t")).collect()] == [0.0, None, 1.0]


def test_long_sides_take_little_memory():
    import tracemalloc

    rng = random.Random(2)
    a = [rng.randrange(500) for _ in range(30_000)]
    b = [x if rng.random() < 0.9 else -1 for x in a]
    tracemalloc.start()
    n = q.lcs(a, b)
    keep_a, keep_b = q.lcs_plan(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == sum(keep_a) == sum(keep_b) and [x for x, k in zip(a, keep_a) if k] == [x for x, k in zip(b, keep_b) if k]
    assert peak < 20e6  # a bit for each pair of tokens would be 112 MB
