import pytest
from pyspark.sql import functions as F

from seqloom.llm import common


@pytest.mark.parametrize("most, share", [(1 << 28, 0.06), (1 << 15, 0.4)])
def test_no_key_is_missed(spark, monkeypatch, most, share):
    monkeypatch.setattr(common, "MOST_BITS", most)
    rows = spark.range(60_000).select("id", F.md5(F.col("id").cast("string")).alias("k"), F.lit(1).alias("_page"))
    keys = common.pinned(rows.where("id % 7 = 0").select("k"), "keys")
    flt = common.KeyFilter.of(keys, "k")
    out = flt.mark(rows, "hit", "k")
    assert out.columns == [*rows.columns, "hit"] and out.count() == 60_000
    assert out.where("id % 7 = 0 AND NOT hit").count() == 0
    others = out.where("id % 7 <> 0 AND hit").count()
    assert others < share * 60_000
    assert flt.passing(rows, "k").columns == rows.columns


def test_an_empty_set_passes_nothing(spark):
    rows = spark.range(10)
    assert common.KeyFilter.of(common.pinned(rows.limit(0), "none"), "id").passing(rows, "id").count() == 0


def test_rows_meet_their_groups(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("g"))
    groups = rows.groupBy("g").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    out = common.joined_to_groups(rows, groups, "g", "n", 5000)
    assert out.count() == 5000 and out.where("g = 0 AND least = 0 AND n = 1667").count() == 1667
    assert out.where("g <> 0 AND (least <> id OR n <> 1)").count() == 0
