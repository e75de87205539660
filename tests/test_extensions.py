import pytest
from pyspark.sql import functions as F

from seqloom.functions import table_functions
from seqloom.operators import evaluation as e
from tests import code_examples


def test_table_functions(spark):
    table_functions.register(spark)
    code = """SELECT * FROM VALUES (1, 'int f ( <unk> * x ) { "a /* " ; }'), (2, NULL), (3, ''), (4, 'int g (') AS t(i, code)"""
    got = spark.sql(f"SELECT i, x.place, x.value FROM ({code}) t, LATERAL lex(t.code) x ORDER BY i, place").collect()
    assert [r.value for r in got if r.i == 1] == ["int", "f", "(", "__unk__", "*", "x", ")", "{", '"a /* "', ";", "}"] and [r.place for r in got if r.i == 1] == list(range(11))
    assert not [r for r in got if r.i in (2, 3)]
    found = spark.sql(f"SELECT i, a.* FROM ({code}) t, LATERAL arguments(t.code) a").collect()
    assert [tuple(r) for r in found] == [(1, 0, "x", "__unk__ *", 1)]


def test_metrics_and_versions_of_ones_own(spark):
    rows = code_examples._measured(spark)
    new = e.Added(e.Metric("range", "Range", "int", None, False), lambda: F.length("hyp"), {"low": F.min, "high": F.max}, lambda s: s["high"] - s["low"])
    own = e.Catalogue().with_metric(new).with_metric(e.added_portion(e.Metric("some", "Some", "portion"), lambda: F.when(F.col("idx") > 0, F.col("idx") > 1)))
    own = own.with_version("late", lambda: F.col("idx") >= 1).with_version("none", lambda: F.lit(None).cast("boolean"))
    got = {(r.version, r.system): r for r in own.summarise(own.in_versions(rows), ["version", "system"]).collect()}
    lengths = {}
    for r in rows.select("system", "idx", F.length("hyp").alias("n")).collect():
        for v in ["eval", "late"] if r.idx >= 1 else ["eval"]:
            lengths.setdefault((v, r.system), []).append(r.n)
    assert {k: r.range for k, r in got.items()} == {k: max(v) - min(v) for k, v in lengths.items()}
    assert all(tuple(r.some) == (1, 2) for r in got.values())
    plain = {r.system: r for r in e.summarise(rows, ["system"]).collect()}
    for s, r in plain.items():
        assert {k: v for k, v in got["eval", s].asDict().items() if k not in ("version", "range", "some")} == r.asDict()
    long = e.long_metrics(own.summarise(rows, ["system"]), ["system"], ["some", "range", "exact_match"], own.metrics())
    assert {r.value for r in long.where("metric = 'some'").collect()} == {0.5} and long.count() == 9
    with pytest.raises(ValueError):
        own.with_metric(new)
    with pytest.raises(ValueError):
        own.with_version("eval", lambda: F.lit(True))
