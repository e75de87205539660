import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import bleu, schedules
from seqloom.functions import text as t
from seqloom.operators import evaluation
from tests.test_sequences import A, B


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.lit(v).cast("array<string>").alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_tokenizer(spark):
    got = one(spark, t.literal_aware(F.col("a")), a=["x", '"a b"', '"', '"q'])
    assert got == ["x", '"', "a", "b", '"', '"', '"', '"', '"']
    assert one(spark, t.words(F.col("a")), a="\x1f a　b\x0b\x85c ") == ["a", "b", "c"]
    assert one(spark, t.strip(F.col("a")), a="\x1c a b\x85\n") == "a b"


def test_subwords(spark):
    for pieces, want in ((["▁a", "b", "▁c"], ["ab", "c"]), (["a", "▁b"], ["a", "b"]), (["▁", "▁x"], ["", "x"]), (["▁a▁b"], ["a▁b"]), ([], [])):
        assert one(spark, t.decode_pieces(F.col("p")), p=pieces) == want
    for pieces, want in ((["ab@@", "c", "d"], ["abc", "d"]), (["ab@@"], ["ab"]), ([], [])):
        assert one(spark, t.decode_bpe(F.col("p")), p=pieces) == want
    ids = spark.sql("SELECT array(5, 6, 3, 7, 3) AS a, array(5) AS b")
    assert ids.select(t.until_end(F.col("a"), 3), t.until_end(F.col("b"), 3)).first()[:] == ([5, 6], [5])


def test_decoding_of_records(spark):
    r = one(spark, t.decode_record(F.col("v")), v="s\x01t1\x01t2\x01k\x00a\x00b\x00k\x00c\x00d\x010.5\x01r\x01h")
    assert (r.src, r.tgt, r.score, r.repo, r.sha) == ("s", "t1\x01t2", 0.5, "r", "h")
    assert {k: (v.decomp, v.orig) for k, v in r.var_names.items()} == {"k": ("c", "d")}
    assert one(spark, t.decode_record(F.col("v")), v="s\x01t\x01\x011\x01r\x01h").var_names == {}
    for bad in ("a\x01b\x01c\x01d", "s\x01t\x01\x01x\x01r\x01h"):
        with pytest.raises(Exception):
            one(spark, t.decode_record(F.col("v")), v=bad)


@settings(max_examples=25, deadline=None)
@given(st.text("ab \x00é", max_size=6), st.text("ab \x00\x01é", max_size=6), st.dictionaries(st.text("kv1", min_size=1, max_size=3), st.tuples(st.text("ab", max_size=3), st.text("cd", max_size=3)), max_size=3), st.floats(-1e6, 1e6))
def test_record_round_trip(spark, src, tgt, names, score):
    import json

    entries = json.dumps({k: {"decomp": a, "orig": b} for k, (a, b) in names.items()})
    row = spark.createDataFrame([(src, tgt, entries, score)], "src string, tgt string, n string, score double")
    names_column = F.from_json("n", "map<string,struct<decomp:string,orig:string>>")
    back = row.select(t.decode_record(t.encode_record(F.col("src"), F.col("tgt"), names_column, F.col("score"), F.lit("r"), F.lit("s"))).alias("r")).first().r
    assert (back.src, back.tgt, back.score) == (src, tgt, score)
    assert {k: (v.decomp, v.orig) for k, v in back.var_names.items()} == names


def test_lengths(spark):
    row = spark.sql("SELECT array(1, 2, 3) AS a, array(1) AS b, cast(array() AS array<int>) AS e")
    got = row.select(t.fits(F.col("a"), F.col("b")), t.fits(F.col("b"), F.col("a")), t.fits(F.col("a"), F.col("a"), 3), t.fits(F.col("a"), F.col("e"))).first()[:]
    assert got == (True, False, False, False)
    assert row.select(t.truncated(F.col("a"), 3), t.padded(F.col("b"), F.lit(3), 9), t.shifted(F.col("a"), 0)).first()[:] == ([1, 2], [1, 9, 9], [0, 1, 2])
    assert one(spark, t.normalised_type(F.col("a")), a=["static", "const", "unsigned", "long", "long"]) == "unsigned long long"
    assert one(spark, t.normalised_type(F.col("a"), cv=True, storage=True), a=["static", "const", "signed", "int"]) == "static const int"
    assert one(spark, t.markdown_id(F.col("a")), a="Some_Name (x)") == "some-name-x"
    assert one(spark, t.indented(F.col("a"), 2), a="x\ny") == "  x\n  y"


def test_schedules(spark):
    steps = spark.createDataFrame([(s,) for s in (0, 5000, 10000, 20000, 30000)], "s long")
    assert [r[0] for r in steps.select(schedules.prefix_size(F.col("s"), F.lit(1000))).collect()] == [10, 500, 707, 1000, 1000]
    steps = spark.createDataFrame([(s,) for s in (0, 8000, 16000, 64000)], "s long")
    for f, want in (
        (schedules.static(F.col("s"), 16000), (0, 0.5, 1, 1)), (schedules.inverse_root(F.col("s"), 16000), (0, 0.003952847, 0.007905694, 0.003952847)),
        (schedules.exponential(F.col("s"), 16000, 0.99, 2000), (0, 0.5, 1, 0.785678141)),
    ):
        assert [r[0] for r in steps.select(f).collect()] == pytest.approx(want, abs=1e-9)
    cosine = [r[0] for r in steps.select(schedules.cosine(F.col("s"), 16000, 112000, 0.1)).collect()]
    assert cosine == pytest.approx([0, 0.5, 1, 0.1 + 0.9 * 0.5 * (1 + math.cos(math.pi * 0.5))])


def test_bleu(spark):
    df = spark.createDataFrame([(A, B), (A, A), (A, []), (None, None)], "r array<string>, h array<string>")
    c = df.select(bleu.count_column(8)("r", "h").alias("c"))
    got = c.select(*(bleu.sentence(F.col("c"), n, s) for n, s in ((4, True), (4, False), (8, True), (8, False)))).collect()
    assert got[0][:] == pytest.approx((64.345888, 53.728497, 64.119702, 0), abs=1e-6)
    assert got[1][:] == pytest.approx((100, 100, 100, 0))
    assert got[2][:] == got[3][:] == (0, 0, 0, 0)
    whole = c.agg(*bleu.corpus_sums(F.col("c"), 4, "b")).select(bleu.corpus("b", 4)).first()[0]
    assert 0 < whole < 100


@pytest.mark.parametrize("ranked", [200_000, 100])
def test_percentiles(spark, monkeypatch, ranked):
    from numpy import percentile

    monkeypatch.setattr(evaluation, "RANKED_VALUES", ranked)
    assert evaluation.percentile_cuts(spark.sql("SELECT CAST(NULL AS DOUBLE) AS n"), "n").first().cuts == [None] * 6

    rows = [float((i * 7919) % 5627 + 12) for i in range(935)]
    df = spark.createDataFrame([(x,) for x in rows], "n double")
    cuts = evaluation.percentile_cuts(df, "n").first().cuts
    assert cuts == pytest.approx([*percentile(rows, [0, 20, 40, 60, 80]), max(rows) + 1])
    binned = df.select(evaluation.percentile_bin(F.col("n"), F.lit(cuts).cast("array<double>")).alias("b")).groupBy("b").count().collect()
    assert {r.b for r in binned} == {20, 40, 60, 80, 100} and sum(r["count"] for r in binned) == 935
