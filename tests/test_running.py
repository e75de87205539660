import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import running


@pytest.mark.parametrize("width", [1, 6, 60])
@pytest.mark.parametrize("by", [None, "g"])
def test_means_over_ranges(spark, by, width):
    """Ranges of a few rows pass theirs on over several ranges."""
    rng = random.Random(width)
    rows = [(i if i else None, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.0, 2.0, 4.0, 8.0]), "x") for i in rng.sample(range(150), 150)]
    df = spark.createDataFrame(rows, "i long, g string, v double, _at string")
    got = {r.i: r.running for r in running.running_mean(df, "v", "i", 20, by, width).collect()}
    ordered = sorted(rows, key=lambda r: r[0] or 0)
    for k, r in enumerate(ordered):
        near = [x[2] for x in [x for x in ordered[: k + 1] if not by or x[1] == r[1]][-20:] if x[2] is not None]
        assert got[r[0]] == (pytest.approx(sum(near) / len(near)) if near else None)
    assert running.running_mean(df.limit(0), "v", "i", 20).count() == 0


@pytest.mark.parametrize("by", [None, "g"])
def test_totals_over_ranges(spark, by):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 5])) for i in rng.sample(range(200), 200)]
    df = spark.createDataFrame(rows, "i long, g string, v long")
    got = {r.i: (r.s, r.n) for r in running.running_totals(df, [F.col("i")], {"s": F.col("v"), "n": F.lit(1)}, by, 7).collect()}
    for i, g, _ in rows:
        mine = [x for x in rows if x[0] <= i and (not by or x[1] == g)]
        assert got[i] == (sum(x[2] or 0 for x in mine), len(mine))


def test_a_million_rows_in_one_order(spark):
    df = spark.range(1_000_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(7)) * 1.0).alias("v"))
    out = running.running_mean(df, "v", "id", 20, width=16)
    exact = df.select("id", "v").alias("a")
    prior = exact.select("id", F.explode(F.sequence(F.col("id"), F.least(F.col("id") + 19, F.lit(999_999)))).alias("k"), "v").groupBy("k").agg(F.avg("v").alias("want"))
    assert out.join(prior, out.id == prior.k).where("abs(running - want) > 1e-9").count() == 0 and out.count() == 1_000_000
    totals = running.running_totals(df.select("id"), [F.col("id")], {"n": F.lit(1)}, width=16)
    assert totals.where("n <> id + 1").count() == 0
