from pyspark.sql import functions as F

from seqloom.llm import common


def test_each_group_has_its_partition(spark):
    for width in (1, 2, 7, 51):
        rows = spark.range(400).withColumn("g", F.pmod("id", F.lit(width)).cast("int"))
        out = common.dealt(rows, width, F.col("g")).withColumn("p", F.spark_partition_id())
        assert out.where("p <> g").count() == 0 and out.select("p").distinct().count() == width


def test_pinned_tables_are_read_back(spark):
    df = spark.sql("SELECT 1L AS a, array(named_struct('x', 2)) AS b UNION ALL SELECT NULL, NULL")
    back = common.pinned(df, "t")
    assert back.dtypes == df.dtypes
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    assert common.pinned(df.limit(0), "t").count() == 0
