"""Positions over a million rows that carry more than their keys, read back from files."""

from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from seqloom.operators import compare, corpus, drawing, overlap
from seqloom.sources.workspace import scratch, spare

N = 1_000_000


@pytest.fixture(scope="module")
def rows(spark):
    path = scratch(spark, "numbering")
    df = spark.range(N).select(
        "id", F.xxhash64("id").alias("h"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(49))).alias("g"),
        F.concat(F.lit("payload "), F.hex(F.xxhash64("id", F.lit(2)))).alias("payload"), F.lit("x").alias("_part"),
    )
    df.repartition(11).write.parquet(path)
    return spark.read.parquet(path)


def whole(df, at):
    got = df.agg(F.count("*").alias("n"), F.count_distinct(at).alias("d"), F.min(at).alias("low"), F.max(at).alias("high")).first()
    return tuple(got)


def test_every_position_once_and_in_order(spark, rows):
    out = corpus.dense_index(rows, [F.col("h"), F.col("id")], "idx", 8)
    assert out.columns == [*rows.columns, "idx"]
    assert whole(out, "idx") == (N, N, 0, N - 1)
    pairs = out.select("idx", "h").alias("a").join(out.select((F.col("idx") - 1).alias("idx"), F.col("h").alias("next")).alias("b"), "idx")
    assert pairs.where("next < h").count() == 0
    assert out.where("_part <> 'x'").count() == 0


def test_groups_stay_whole(spark, rows):
    out = corpus.grouped_index(rows, "g", [F.col("h"), F.col("id")], 8)
    sizes = out.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("position").alias("d"), F.min("position").alias("low"), F.max("position").alias("high"), F.min("group_size").alias("s"), F.max("group_size").alias("t"))
    assert sizes.agg(F.sum("n")).first()[0] == N
    assert sizes.where("n <> d OR low <> 0 OR high <> n - 1 OR s <> n OR t <> n").count() == 0


def test_samples_and_prefixes_are_exact(spark, rows):
    assert corpus.reservoir(rows, 500_000, 3, "id").agg(F.count("*"), F.count_distinct("id")).first()[:] == (500_000, 500_000)
    prefix = corpus.prefix(rows.withColumn("score", F.col("h") / 2), "id", 300_000)
    cut = rows.select(F.expr("percentile_disc(0.3) WITHIN GROUP (ORDER BY h / 2)")).first()[0]
    assert prefix.count() == 300_000 and prefix.agg(F.max("score")).first()[0] == cut


def test_comparison_keeps_both_sides(spark, rows):
    both = rows.select(F.col("id").alias("idx"), "payload", F.inline(F.array(F.struct(F.lit("a").alias("system"), F.col("h").alias("v")), F.struct(F.lit("b").alias("system"), (F.col("h") / 2).alias("v")))))
    out = compare.better_on_all(both, "idx", "a", "b", ["v"])
    n = rows.where("h > h / 2").count()
    assert whole(out, "ordinal") == (n, n, 0, n - 1)


def test_weighted_sample(spark, rows):
    counts = rows.select(F.col("payload").alias("word"), F.lit(2).cast("long").alias("count"), "h")
    assert drawing.draw(counts, 400_000, 5).count() == 400_000


def test_neighbours_among_a_million(spark, rows):
    train = rows.where("id % 10 <> 0").withColumn("text", F.hex("h"))
    few = rows.where("id % 1000 = 0").withColumn("text", F.hex(F.xxhash64("id", F.lit(7)))).select("id", "text", "payload")
    few = few.unionByName(rows.where("id % 1000 = 1").select("id", F.hex("h").alias("text"), "payload"))  # equal to training texts
    found = overlap.neighbours(train, few, "text", "id").toPandas()
    texts = sorted(r.text for r in train.select("text").distinct().collect())
    assert len(found) == few.count()
    for r in found.itertuples():
        at = bisect_right(texts, r.text)
        assert r.left_text == (texts[at - 1] if at else None) and r.right_text == (texts[at] if at < len(texts) else None)


def test_spare_names(spark):
    assert spare(spark.range(1).withColumn("_A", F.lit(1)), "a", "b") == ("__a", "__b")
