"""Work that is dear by the row is spread over tasks and done once."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqloom.functions import bleu, clang, table_functions
from seqloom.operators import compare, evaluation
from seqloom.plans import code_queries, evaluation_queries
from seqloom.sources import sinks, workspace
from tests.code_examples import report_examples

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_small_file_are_dealt(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    one = spark.read.parquet(f"{tmp_path}/t")
    assert one.rdd.getNumPartitions() == 1
    dealt = workspace.dealt(one, 100)
    assert dealt.rdd.getNumPartitions() == 10 and workspace.dealt(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert max(dealt.rdd.glom().map(len).collect()) <= 110 and sorted(r.id for r in dealt.collect()) == list(range(1000))
    assert workspace.dealt(one.limit(0)).count() == 0
    assert code_queries._rows(spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_lateral_tokens_reads_each_code_once(spark):
    assert plan(code_queries.lateral_tokens(spark, SF)).count("EvalPythonUDTF") == 1
    table_functions.register(spark)
    code = "SELECT * FROM VALUES (1, 'int f ( x )', 'int <unk> ( x'), (1, 'a', 'b c'), (2, NULL, 'a'), (3, '', '') AS t(i, code, other)"
    got = spark.sql(f"SELECT i, x.* FROM ({code}) t, LATERAL lex_both(t.code, t.other) x").collect()
    assert sorted(tuple(r) for r in got) == [
        (1, 0, "ID", "a", "ID", "b"), (1, 0, "INT", "int", "INT", "int"), (1, 1, "ID", "f", "ID", "__unk__"), (1, 2, "SYMBOL", "(", "SYMBOL", "("), (1, 3, "ID", "x", "ID", "x"),
    ]


def test_an_example_is_read_once_for_all_systems(monkeypatch):
    read, counted = [], []
    lex, counter = clang.lex, bleu.Counter
    monkeypatch.setattr(clang, "lex", lambda code: read.append(code) or lex(code))
    monkeypatch.setattr(bleu, "Counter", lambda x=(): counted.append(1) or counter(x))
    src, tgt = "int once ( int v1 ) { return v1 ; }", "int once ( char * a ) { return a ; }"
    for hyp in (tgt, "int once ( char * b ) { return b ; }", "int once ("):
        evaluation.measure_row(src, tgt, hyp, False)
    assert sorted(read) == sorted({src, tgt, "int once ( char * b ) { return b ; }", "int once ("})
    assert len(counted) <= 8 + 8 + 4 + 4 + 4 + 4  # the target's n-grams once; equal tokens aren't counted


def test_counts_of_ngrams_by_the_definition():
    rng = random.Random(7)
    for _ in range(300):
        ref, hyp = ([rng.choice("abc") for _ in range(rng.randint(0, 8))] for _ in range(2))
        want = []
        for n in range(1, 6):
            left, right = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (ref, hyp))
            want.append((sum((left & right).values()), sum(right.values())))
        assert bleu.counts(ref, hyp, 5) == ([m for m, _ in want], [p for _, p in want], len(hyp), len(ref))


def test_a_report_is_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def line(i):
        made.add(1)
        return str(i)

    document = spark.range(500).select(F.col("id").alias("ordinal"), line("id").alias("line"))
    sinks.write_report(document, f"{tmp_path}/r", 4)
    assert made.value == 500 and spark.read.text(f"{tmp_path}/r").count() == 500


def test_shown_code_is_lexed_once(spark):
    assert plan(report_examples(spark)).count("pretty(") == 0
    row = spark.sql("SELECT 'int f ( int a ) { return a ; }' AS c, 'int f (' AS cut, CAST(NULL AS string) AS none")
    shown = clang.shown_column()
    r = row.select(shown("c", "c", F.lit(True)).alias("a"), shown("cut", "none", F.lit(False)).alias("b"), shown("none", "c", F.lit(True)).alias("d")).first()
    assert r.a.signature.name == "f" and r.a.signature.parsable and r.a.code == "int f(int a) {\n  return a;\n}"
    assert not r.b.signature.parsable and r.b.code is None and not r.d.signature.parsable and r.d.code == r.a.code


def test_parts_of_edit_distances_are_dealt(spark):
    for name in ("edit_distance_costs", "edit_distance", "osa_similarity"):
        assert evaluation_queries.Q[name](spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_signatures_are_parsed_by_all_tasks(spark):
    assert code_queries.func_signature(spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_only_what_is_asked_for_is_measured(monkeypatch):
    """the pairing of arguments takes no n-grams, string literals or likeness of what was paired."""
    counted = []
    monkeypatch.setattr(bleu, "counts_of", lambda *x: counted.append(x))
    monkeypatch.setattr(evaluation, "agreeing", lambda *x: counted.append(x))
    tgt, hyp = 'int asked ( char * a , int n ) { return "x" ; }', "int asked ( int n , char * a ) { return n ; }"
    got = evaluation.measure_row("int asked ( int a , int n ) { }", tgt, hyp, False, frozenset(("match_idx", "missing_args")))
    assert got["match_idx"] == [1, 0] and got["missing_args"] == [] and not counted


def test_measured_columns_are_those_asked_for(spark):
    """pointers are told from pairs alone, and as among all metrics; what isn't a metric is an error."""
    rows = code_queries._rows(spark, SF).where("idx < 40")
    args = F.col("src"), F.col("tgt"), F.col("hyp"), F.lit(False)
    whole, one = evaluation.measure(rows, *args), evaluation.measure(rows, *args, ("pointer_conversion",))
    assert one.columns == [*rows.columns, "pointer_conversion"]
    value = lambda df: sorted((r.idx, r.system, tuple(r.pointer_conversion)) for r in df.select("idx", "system", "pointer_conversion").collect())
    assert value(one) == value(whole)
    with pytest.raises(ValueError, match="unknown"):
        evaluation.measure(rows, *args, ("unknown",))


def test_a_summary_measures_what_it_sums(spark):
    """whatever summarise() reads is measured, and no more; sentence scores come with their counts."""
    rows = code_queries._rows(spark, SF).where("idx < 40")
    args = F.col("src"), F.col("tgt"), F.col("hyp"), F.lit(False)
    whole, part = evaluation.measure(rows, *args), evaluation.measure(rows, *args, evaluation.SUMMARISED)
    assert set(part.columns) == {*rows.columns, *evaluation.SUMMARISED, "bleu4", "bleu8", "bleu4_no_var"}
    summed = lambda df: evaluation.summarise(df, ["system"]).orderBy("system").collect()
    assert summed(part) == summed(whole)


def test_compared_systems_count_what_is_compared(spark, monkeypatch):
    """hits and precision are of single words, so no longer n-grams are made in Python."""
    orders, counted = [], bleu.count_column
    monkeypatch.setattr(bleu, "count_column", lambda order: orders.append(order) or counted(order))
    rows = evaluation_queries._pseudo(spark, SF)
    assert orders == [1]
    for r in rows.where("system = 'answer'").collect():
        assert r.exact == 1 and r.hits == r.n_words == r.target_words
    assert plan(rows.where("system = 'echo'")).count("ArrowEvalPython") == 1


def test_compared_metrics_are_made_once(spark, monkeypatch):
    """each side's metrics come from one pass through Python, not from a second one that looks for nulls."""
    monkeypatch.setattr(compare, "dense_index", lambda df, *_: df)
    assert plan(evaluation_queries._compared(spark, SF)).count("ArrowEvalPython [") == 2
    rows = spark.sql("SELECT * FROM VALUES (1, 'a', 3, 1.0), (1, 'b', 2, 0.5), (2, 'a', NULL, 1.0), (2, 'b', 2, 0.5), (3, 'a', 3, 1.0), (3, 'b', NULL, 0.5), (4, 'a', 2, 1.0), (4, 'b', 2, 0.5) AS t(i, system, x, y)")
    assert [r.i for r in compare.better_on_all(rows, "i", "a", "b", ["x", "y"]).collect()] == [1]


def test_bodies_are_not_lexed_for_lenient_signatures(spark):
    """code is read up to its body's brace, not one in a text or a comment, with the same signature as all of it."""
    codes = ["int f ( int a ) { return a ; }", "int f ( a ) char * a ; { { } }", 'int f ( int b[ sizeof "{" ] ) /* { */ { x ; }', "int f (", "", "{", "} int g ( void ) {", "int <unk> ( int c ) { <unk> }", "int f ( char c ) // {\n;", "void '{' h ( ) { }"]
    rng = random.Random(10)
    codes += [" ".join(rng.choice(["int", "f", "(", ")", "{", "}", "*", ",", ";", "[", "]", "/*", "*/", '"{"', "//", "\n"]) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    for code in codes:
        read, every = clang.head(code), clang.values(code)
        assert read == (every[: every.index("{") + 1] if "{" in every else every)
        assert clang.parsed(read, strict=False) == clang.parsed(every, strict=False)
    df = spark.createDataFrame([*enumerate(codes), (len(codes), None)], "i int, c string").coalesce(1)
    got = {r.i: (r.a.asDict(True), r.b.asDict(True)) for r in df.select("i", clang.signature_column(False)("c").alias("a"), clang.signature_column()("c").alias("b")).collect()}
    assert got == {i: tuple(clang.as_row(*clang.parsed(clang.values(c or ""), strict)) for strict in (False, True)) for i, c in enumerate([*codes, None])}
