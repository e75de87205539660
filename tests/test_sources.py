import glob
import gzip
import json

import pytest
from pyspark.sql import functions as F

from seqloom.functions import formatting
from seqloom.sources import config, readers, sinks
from seqloom.streaming import ingest


def test_matched_functions(spark, tmp_path):
    folder = tmp_path / "owner" / "name"
    folder.mkdir(parents=True)
    good = {"decompiled_tokens": ["a", "b"], "original_tokens": ["c"], "variable_names": {"k": ["x", "y"]}, "binary_hash": "h", "ast": {}}
    (folder / "matched_funcs.jsonl").write_text(json.dumps(good) + "\n{broken\n")
    df = readers.matched_functions(spark, f"{tmp_path}/*/*/matched_funcs.jsonl").cache()
    assert df.count() == 2
    r = readers.well_formed(df).first()
    assert (r.decompiled_code, r.original_code, r.repo, r.sha, r.var_names["k"].orig) == ("a\0b", "c", "owner/name", "h", "y")


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" if i % 5 else " \t\n" for i in range(3000)))
    (tmp_path / "b.txt").write_text("last")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [(r.idx, r.value) for r in readers.lines(spark, str(tmp_path)).orderBy("idx").collect()]
        kept = readers.lines(spark, str(tmp_path), skip_empty=False)
        assert kept.count() == 3001 and kept.where("value = ''").count() == 600
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [f"line {i}" for i in range(3000) if i % 5] + ["last"]
    assert got == list(enumerate(want))


def test_records_through_files(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1, 'a\\0b', 'c\\0d', 0.5D, 'r', 's'), (0, 'e', 'f', 1D, 'r', 't') AS t(pos, src, tgt, score, repo, sha)")
    rows = rows.withColumn("var_names", F.from_json(F.lit('{"k": {"decomp": "x", "orig": "y"}}'), "map<string,struct<decomp:string,orig:string>>"))
    sinks.write_records(rows, f"{tmp_path}/r", "pos")
    back = readers.encoded(spark, f"{tmp_path}/r").orderBy("idx").collect()
    assert [(r.src, r.tgt, r.score, r.var_names["k"].decomp) for r in back] == [("e", "f", 1.0, "x"), ("a\0b", "c\0d", 0.5, "x")]
    pairs = readers.pairs(spark, f"{tmp_path}/r", additional=True).orderBy("idx").collect()
    assert [(r.src, r.tgt, r.score, r.sha) for r in pairs] == [("e", "f", "1.0", "t"), ("a b", "c d", "0.5", "s")]
    sinks.write_splits(rows.withColumn("split", F.lit("dev")), f"{tmp_path}/s", F.col("src"), "pos")
    assert [r.value for r in spark.read.text(f"{tmp_path}/s/split=dev").collect()] == ["e", "a\0b"]
    sinks.write_blocks(rows, f"{tmp_path}/b", 1)
    assert readers.blocks(spark, f"{tmp_path}/b").select("block").distinct().count() == 2
    both = sinks.training_lines(rows.select(F.split("src", "\0").alias("a"), F.array(F.lit("k")).alias("b"), "var_names"), F.col("b"), F.col("a"), F.col("var_names"))
    assert sorted(r.value for r in both.collect()) == ["a b", "e", "x y", "x y"]
    sinks.write_reference_pairs(rows, f"{tmp_path}/p", F.col("src"), F.col("tgt"), "pos")
    assert [r.value for r in spark.read.text(f"{tmp_path}/p/ref").collect()] == ["f", "c\0d"]


def test_small_readers(spark, tmp_path):
    (tmp_path / "v").write_text("tok 1\n\n  other\t2\n")
    assert [(r.id, r.token) for r in readers.vocabulary(spark, f"{tmp_path}/v").orderBy("id").collect()] == [(0, "tok"), (1, "other")]
    (tmp_path / "n").write_text("1.5\n2")
    assert [r.value for r in readers.numbers(spark, f"{tmp_path}/n").orderBy("idx").collect()] == [1.5, 2.0]
    (tmp_path / "l").write_text("o/n abc\n")
    assert readers.binary_list(spark, f"{tmp_path}/l").first()[1:] == ("o/n", "abc")
    repos = spark.createDataFrame([("b", "x", 1), ("a", "y", 2), ("c", "z", 0)], "repo_owner string, repo_name string, funcs_matched int")
    assert [r.repo_owner for r in readers.registry(repos, 1).collect()] == ["a"] and readers.registry(repos).count() == 2
    canon = readers.canonical(spark.sql("SELECT 'a\\u0001b' AS src, 'c' AS tgt, 'd\\u0001' AS raw_tgt")).first()
    assert canon[:] == ("a\0b", "c", "d\0")
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump({"metrics": [1], "examples": []}, f)
    assert readers.report(spark, f"{tmp_path}/r.json.gz").first().metrics == [1]
    a, b = spark.createDataFrame([(0, "x"), (1, "y")], "idx long, s string"), spark.createDataFrame([(1, 2), (0, 1)], "idx long, n int")
    assert sorted(r[:] for r in readers.zipped(a, b).collect()) == [(0, "x", 1), (1, "y", 2)]
    with pytest.raises(Exception):
        readers.zipped(a, b.limit(1)).collect()


def test_report_sink(spark, tmp_path):
    from tests import code_examples

    sinks.write_report(code_examples.report_json(spark, ""), f"{tmp_path}/out", 3)
    members = sorted(glob.glob(f"{tmp_path}/out/part-*.gz"))
    assert len(members) == 3
    whole = json.loads(gzip.decompress(b"".join(open(m, "rb").read() for m in members)))  # one valid gzip file of one document
    assert [e["index"] for e in whole["examples"]] == sorted(e["index"] for e in whole["examples"]) and len(whole["examples"]) == 3
    head = readers.report_head(spark, f"{tmp_path}/out").first()
    assert (len(head.metrics), len(head.systems)) == (len(whole["metrics"]), len(whole["systems"]))
    schema = code_examples.report_examples(spark).schema
    found = {r["index"]: r for r in readers.report_examples(spark, f"{tmp_path}/out", schema).collect()}
    assert {e["index"]: e["target"]["code"] for e in whole["examples"]} == {i: r.target.code for i, r in found.items()}
    spark.createDataFrame([("not an example,",)], "value string").write.mode("append").text(f"{tmp_path}/out")
    with pytest.raises(Exception):
        readers.report_examples(spark, f"{tmp_path}/out", schema).collect()


def test_config(tmp_path):
    (tmp_path / "base.yaml").write_text("a: {x: 1, y: 2}\nlist: [1]\n")
    (tmp_path / "t.json").write_text('{"j": 1}')
    (tmp_path / "raw.txt").write_text("raw")
    (tmp_path / "main.yaml").write_text("top: !template {path: base.yaml, overrides: [{a: {y: 3}}, {list: [2]}]}\nj: !include t.json\nr: !include raw.txt\n")
    with open(tmp_path / "main.yaml") as f:
        assert config.load(f) == {"top": {"a": {"x": 1, "y": 3}, "list": [2]}, "j": {"j": 1}, "r": "raw"}


def test_formatting():
    table = formatting.markdown_table([["A", "B"], ["x", "10"]], ["left", "right"])
    assert table.split("\n") == ["| A   |   B |", "| --- | --: |", "| x   |  10 |"]
    for bad in ([], [["a"], ["b", "c"]]):
        with pytest.raises(ValueError):
            formatting.markdown_table(bad)
    assert formatting.metric_value("portion", {"correct": 3.0, "total": 4}) == "3 / 4"
    assert formatting.metric_value("portion", {"correct": 3.5, "total": 4}) == "3.50 / 4"
    assert formatting.metric_value("portion", {"correct": 3.0, "total": 4}, 4) == "0.7500"
    assert formatting.metric_value("confusion_mat", {"tp": 1, "fp": 2, "fn": 3}) == "P: 1 / 3, R: 1 / 4"
    assert formatting.histogram([(0.0, 2), (0.5, 1)], 4).count("#") == 6


def test_stream(spark, tmp_path):
    schema = "k string, ts timestamp"
    rows = spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00'), ('b', timestamp'2024-01-01 00:01:00'), ('a', timestamp'2024-01-01 00:02:00') AS t(k, ts)")
    rows.write.parquet(f"{tmp_path}/in")
    for keep, time in (("x", None), ("y", "ts")):
        stream = ingest.deduplicated(ingest.file_stream(spark, f"{tmp_path}/in", schema), ["k"], time)
        ingest.drain(stream, f"{tmp_path}/{keep}", f"{tmp_path}/c{keep}").awaitTermination()
        assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/{keep}").collect()) == ["a", "b"]
    counted = ingest.windowed_counts(ingest.file_stream(spark, f"{tmp_path}/in", schema), "ts", "10 minutes", "k")
    assert counted.isStreaming and "window" in counted.columns


def test_files(spark, tmp_path):
    from seqloom.sources import files

    (tmp_path / "in" / "o").mkdir(parents=True)
    (tmp_path / "in" / "o" / "abc.bin").write_text("x")
    done = files.copy_files([("o", "abc"), ("o", "none")], {"binary": f"{tmp_path}/in/{{repo}}/{{sha}}.bin"}, f"{tmp_path}/out")
    assert done == {"binary": 1} and (tmp_path / "out" / "binary" / "abc.bin").read_text() == "x"
    made = []
    build = lambda: made.append(1) or spark.range(3)
    assert files.memoised(spark, f"{tmp_path}/m", build).count() == files.memoised(spark, f"{tmp_path}/m", build).count() == 3 and len(made) == 1
    examples = spark.sql("SELECT 0L AS idx, 's' AS src")
    files.write_bundle(examples, spark.sql("SELECT 0L AS idx, 'a' AS system, 'h' AS hyp, 0.5D AS overlap"), f"{tmp_path}/b")
    assert files.read_bundle(spark, f"{tmp_path}/b").first().asDict() == {"idx": 0, "system": "a", "hyp": "h", "overlap": 0.5, "src": "s"}


def test_more_sinks(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1, 0.5D, 'a b', 'a c', 'a c'), (0, NULL, 'x', 'y', 'z') AS t(idx, score, s, t, h)")
    sinks.write_scores(rows, f"{tmp_path}/s", "idx", "score")
    assert [r.value for r in spark.read.text(f"{tmp_path}/s").collect()] == ["", "0.5"]
    sinks.write_merged(spark.sql("SELECT * FROM VALUES (1, 5, 'b'), (0, NULL, 'c'), (2, 1, 'a') AS t(i, o, v)"), f"{tmp_path}/m", F.col("v"), "o", "i")
    assert [r.value for r in spark.read.text(f"{tmp_path}/m").collect()] == ["a", "b", "c"]
    blocks = sinks.annotated(rows, "s", "t", "h", "score", "idx").collect()
    assert [r["index"] for r in blocks] == [0, 1] and "\033[92ma\033[0m" in blocks[1].block
