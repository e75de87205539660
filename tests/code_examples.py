"""Three functions by hand: what two systems make of them, beside the baseline's own source."""

from pyspark.sql import functions as F

from seqloom.functions import text
from seqloom.operators import evaluation, report

#: Inline examples: source, target and what two systems make of it.
CODE = (
    (0, "int f ( void ) { v1 = 1 ; return v1 ; }", "int count ( void ) { count = 1 ; return count ; }", "int count ( void ) { n = 1 ; return n ; }", "int f ( int a ) { return 1 ; }"),
    (1, "char g ( int v1 , int n ) { return v1 ; }", 'static char * g ( const char * s , int n ) { puts ( "x" ) ; return s ; }', 'char * g ( int n , char * s ) { puts ( "x" ) ; return s ; }', 'char g ( int s ) { puts ( "y" ) ; }'),
    (2, "int h ( v1 , b ) int v1 ; char * b ; { }", "int h ( a , b ) int a ; char * b ; { }", "int h ( int a , char * b ) { }", "int h ("),
)
SYSTEMS = ("decompiled", "good", "bad")


def _code(spark):
    """``idx, system, src, tgt, hyp, var_names, repo, sha, overlap_score``; the baseline's hypothesis is its own source."""
    rows = [(i, s, src, tgt, hyp, "r", "c0ffee", 0.0 if s == "decompiled" else 0.5) for i, src, tgt, good, bad in CODE for s, hyp in zip(SYSTEMS, (src, good, bad), strict=True)]
    df = spark.createDataFrame(rows, "idx long, system string, src string, tgt string, hyp string, repo string, sha string, overlap_score double")
    names = F.from_json(F.lit('{"v1": {"decomp": "v1", "orig": "s"}}'), "map<string,struct<decomp:string,orig:string>>")
    return df.withColumn("var_names", names)


def _measured(spark):
    rows = _code(spark)
    replaced = text.replace_by_map(F.col("src"), F.col("var_names"))
    base = F.col("system") == "decompiled"
    return evaluation.measure(rows, replaced, F.col("tgt"), F.when(base, replaced).otherwise(F.col("hyp")), base)


def signature_summary(spark, sf_dir):
    """All eighteen metrics by system, in long form."""
    summary = evaluation.summarise(_measured(spark), ["system"])
    return evaluation.long_metrics(summary, ["system"], [m.key for m in evaluation.METRICS]).select("system", "metric", F.round("value", 6).alias("value"))


def report_examples(spark):
    return report.example_rows(_measured(spark), "decompiled")


def report_json(spark, sf_dir):
    measured, examples = _measured(spark), report_examples(spark)
    systems = evaluation.summarise(measured, ["system"]).withColumnRenamed("system", "key")
    return report.document(examples, systems)
