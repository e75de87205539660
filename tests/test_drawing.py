import math
from collections import Counter

import numpy as np
import pytest

from seqloom.operators import drawing


def chances(good, bad, draws):
    low, high = max(0, draws - bad), min(good, draws)
    whole = math.comb(good + bad, draws)
    return low, [math.comb(good, k) * math.comb(bad, draws - k) / whole for k in range(low, high + 1)]


@pytest.mark.parametrize("case", [(3, 5, 4), (0, 5, 3), (5, 0, 3), (10, 10, 20), (10, 10, 0), (1, 999, 500), (400, 300, 200), (7, 3, 9)])
def test_quantiles_by_definition(case):
    low, p = chances(*case)
    total = np.cumsum(p)
    for u in np.linspace(0.00051, 0.99947, 991):
        assert drawing.hypergeometric(*case, u) == low + int((total <= u).sum())
    assert drawing.hypergeometric(*case, 0.0) == low + next(k for k, x in enumerate(total) if x > 0)


@pytest.mark.parametrize("case", [(10**12, 3 * 10**12, 10_000), (5, 10**15, 10**14), (10**18, 10**18, 10**7), (1, 10**12, 1)])
def test_large_counts_have_the_right_moments(case):
    good, bad, draws = case
    total = good + bad
    x = np.array([drawing.hypergeometric(good, bad, draws, (k + 0.5) / 20_000) for k in range(20_000)], float)
    mean, variance = draws * good / total, draws * good / total * bad / total * (total - draws) / (total - 1)
    assert abs(x.mean() - mean) < 0.01 * variance**0.5 + 1e-4 and x.var() == pytest.approx(variance, rel=0.02, abs=1e-4)


def test_sizes_means_and_variances(spark):
    """Over many seeds the draws of each word have the mean and variance of draws without replacement."""
    kinds = [(f"w{k}", n) for k, n in enumerate([500, 300, 100, 50, 30, 10, 5, 3, 1, 1])]
    got = np.array([drawing.shared_out(kinds, 200, seed) for seed in range(3000)])
    n = np.array([c for _, c in kinds])
    assert (got.sum(1) == 200).all() and (got <= n).all()
    p = n / 1000
    assert got.mean(0) == pytest.approx(200 * p, rel=0.05, abs=0.03)
    assert got.var(0) == pytest.approx(200 * p * (1 - p) * 800 / 999, rel=0.12, abs=0.02)
    both = np.cov(got[:, 0], got[:, 1])[0, 1]
    assert both == pytest.approx(-200 * p[0] * p[1] * 800 / 999, rel=0.15)


def test_draws_of_huge_bags(spark):
    rows = [("the", 10**12), ("of", 3 * 10**11), ("rare", 2), (None, 10**11), ("the", 10**12), ("none", 0), ("null", None), *((f"w{k}", 10**6) for k in range(2000))]
    df = spark.createDataFrame(rows, "word string, count long")
    got = {r.word: r.n for r in drawing.draw_counts(df, 100_000, 5).collect()}
    total = sum(n or 0 for _, n in rows)
    assert sum(got.values()) == 100_000 and "none" not in got and "null" not in got
    for w, n in (("the", 2 * 10**12), ("of", 3 * 10**11), (None, 10**11)):
        p = n / total
        assert abs(got[w] - 100_000 * p) < 5 * (100_000 * p * (1 - p)) ** 0.5
    assert got == {r.word: r.n for r in drawing.draw_counts(df.repartition(7), 100_000, 5).collect()}
    assert got != {r.word: r.n for r in drawing.draw_counts(df, 100_000, 6).collect()}


def test_laid_out(spark):
    df = spark.createDataFrame([("a", 900_000), ("b", 100_000)], "word string, count long")
    assert Counter(r.word for r in drawing.draw(df, 400, 3).collect()).total() == 400
    assert {r.word: r["count"] for r in drawing.draw(df, 5_000_000, 3).groupBy("word").count().collect()} == {"a": 900_000, "b": 100_000}
    assert drawing.draw(df.limit(0), 10, 3).count() == 0 and drawing.draw(df, 0, 3).count() == 0


def test_more_buckets(spark):
    df = spark.range(20_000).selectExpr("concat('w', id) AS word", "1 + id % 7 AS count")
    got = drawing.draw_counts(df, 30_000, 1, digits=3)
    assert got.agg({"n": "sum"}).first()[0] == 30_000
    assert got.join(df, "word").where("n > count").count() == 0
