"""Queries on C functions. Each part makes one function of four forms, its decompiled source, and what three systems say; the SQL
states what must come out from the parts' columns and the forms, without reading any code."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import clang, table_functions, text
from seqloom.operators import corpus, evaluation, report
from seqloom.plans.corpus_queries import PAIRS, table
from seqloom.plans.evaluation_queries import bleu_sql, score_sql
from seqloom.sources import readers, sinks
from seqloom.sources.workspace import dealt, pinned, scratch

Q: dict = {}
S: dict[str, str] = {}
SYSTEMS = ("same", "swapped", "cut")

#: Code by form (part key modulo 4): target, decompiled source, and the target with its parameters in another order.
#: K stands for the part's key, Z for its size.
FORMS = (
    ("int fK ( void ) { count = Z ; return count ; }", "int fK ( void ) { v1 = Z ; return v1 ; }", "int fK ( void ) { count = Z ; return count ; }"),
    (
        'static char * fK ( const char * bufZ , int n ) { puts ( "xZ" ) ; return bufZ ; }', "char fK ( int v1 , int n ) { return v1 ; }",
        'static char * fK ( int n , const char * bufZ ) { puts ( "xZ" ) ; return bufZ ; }',
    ),
    ("void fK ( int ( * cbZ ) ( int ) , unsigned long v [ Z ] ) { cbZ ( v [ 0 ] ) ; }", "void fK ( long v1 , long v ) { v1 ( v ) ; }", "void fK ( unsigned long v [ Z ] , int ( * cbZ ) ( int ) ) { cbZ ( v [ 0 ] ) ; }"),
    (
        "int fK ( a , bZ ) int a ; char * bZ ; { if ( ! a ) { bZ ++ ; } else { a = Z ; } return a ; }", "int fK ( int a , int v1 ) { if ( ! a ) { v1 ++ ; } else { a = Z ; } return a ; }",
        "int fK ( char * bZ , int a ) { if ( ! a ) { bZ ++ ; } else { a = Z ; } return a ; }",
    ),
)


def case(cells) -> str:
    """An SQL expression by form, K and Z put in."""
    put = lambda x: "replace(replace('" + x.replace("'", "''") + "', 'K', p_partkey || ''), 'Z', p_size || '')"
    return "CASE p_partkey % 4 " + " ".join(f"WHEN {i} THEN {put(x) if isinstance(x, str) else x}" for i, x in enumerate(cells)) + " END"


TARGET, SOURCE, SWAPPED = (case([form[i] for form in FORMS]) for i in range(3))
ROWS = f"""rows AS (SELECT p_partkey, p_size, p_partkey % 4 AS form, {TARGET} AS tgt, {SOURCE} AS src FROM part), said AS (SELECT *, unnest(['same', 'swapped', 'cut']) AS system FROM rows),
  code AS (SELECT *, CASE system WHEN 'same' THEN tgt WHEN 'swapped' THEN {SWAPPED} ELSE 'int f' || p_partkey || ' (' END AS hyp FROM said)"""
#: What is expected by form and system: K&R parameters make no difference, code that is cut off has no signature.
N_ARGS = "[0, 2, 2, 2][form + 1]"
SWAP = "(system = 'swapped' AND form > 0)"


def query(sql: str):
    def register(f):
        Q[f.__name__], S[f.__name__] = f, sql
        return f

    return register


def _rows(spark, sf_dir):
    """``idx, system, src, tgt, hyp, var_names, repo, sha, overlap_score``."""
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    code = lambda i: F.expr(case([form[i] for form in FORMS]))
    rows = parts.select(F.col("p_partkey").alias("idx"), "p_partkey", "p_size", code(1).alias("src"), code(0).alias("tgt"), code(2).alias("swapped"))
    cut = F.concat(F.lit("int f"), F.col("idx").cast("string"), F.lit(" ("))
    said = F.inline(F.array(*[F.struct(F.lit(s).alias("system"), c.alias("hyp")) for s, c in zip(SYSTEMS, (F.col("tgt"), F.col("swapped"), cut), strict=True)]))
    names = F.from_json(F.lit('{"v1": {"decomp": "v1", "orig": "s"}}'), "map<string,struct<decomp:string,orig:string>>")
    return rows.select("idx", "p_size", "src", "tgt", said).withColumn("var_names", names).withColumn("repo", F.lit("r")).withColumn("sha", F.md5("tgt")).withColumn("overlap_score", F.col("p_size") / 100)


def _measured(spark, sf_dir, *only):
    rows = _rows(spark, sf_dir)
    return evaluation.measure(rows, text.replace_by_map(F.col("src"), F.col("var_names")), F.col("tgt"), F.col("hyp"), F.lit(False), only)


KEYWORD_LIST = ", ".join(f"'{k}'" for k in sorted(clang.KEYWORDS))
LEXED = f"""lexed AS (SELECT p_partkey, generate_subscripts(w, 1) - 1 AS place, unnest(w) AS value FROM (SELECT p_partkey, string_split(tgt, ' ') AS w FROM rows)),
  typed AS (SELECT p_partkey, place, value, CASE WHEN value IN ({KEYWORD_LIST}) THEN upper(value) WHEN regexp_full_match(value, '[A-Za-z]\\w*') THEN 'ID' WHEN regexp_full_match(value, '[1-9][0-9]*') THEN 'INT_CONST_DEC' WHEN value = '0' THEN 'INT_CONST_OCT' WHEN value[1] = '"' THEN 'STRING_LITERAL' ELSE 'SYMBOL' END AS type FROM lexed)"""


@query(f"WITH {ROWS}, {LEXED} SELECT p_partkey AS idx, CAST(place AS BIGINT) AS place, type, value FROM typed")
def c_tokens(spark, sf_dir):
    """Tokens of targets written tightly, with comments between."""
    rows = _rows(spark, sf_dir).where("system = 'same'")
    tight = F.concat(F.regexp_replace("tgt", r" ?([(){};,\[\]*]) ?", "$1"), F.lit(" // end\n"))
    noted = F.regexp_replace(tight, ";", "; /* ; */")
    return rows.select("idx", F.posexplode(clang.lexed(noted)).alias("place", "t")).select("idx", F.col("place").cast("long").alias("place"), "t.type", "t.value")


@query(f"WITH {ROWS}, {LEXED} SELECT p_partkey AS idx, place, type, value, CASE WHEN type = 'ID' THEN replace(value, 'count', '__unk__') ELSE value END AS masked FROM typed")
def lateral_tokens(spark, sf_dir):
    """Tokens of targets by a table function in SQL, beside those of the same code with a name unknown."""
    table_functions.register(spark)
    _rows(spark, sf_dir).where("system = 'same'").select("idx", "tgt").createOrReplaceTempView("seqloom_code")
    return spark.sql("SELECT c.idx, t.place, t.type, t.value, t.other_value AS masked FROM seqloom_code c, LATERAL lex_both(c.tgt, replace(c.tgt, 'count', '<unk>')) t")


@query(
    f"""WITH {ROWS}, v AS (SELECT *, 'eval' AS version FROM code UNION ALL SELECT *, 'large' FROM code WHERE p_size > 25 UNION ALL SELECT *, 'pointers' FROM code WHERE contains(tgt, '*'))
    SELECT version, system, CAST(sum(CAST(length(hyp) <= length(tgt) AS INTEGER)) AS BIGINT) AS correct, count(*) AS total, round(avg(length(hyp) / length(tgt)), 6) AS length_ratio, round(sum(CAST(system = 'same' OR (system = 'swapped' AND form = 0) AS INTEGER)) / count(*), 6) AS exact_match FROM v GROUP BY version, system"""
)
def added_metrics(spark, sf_dir):
    """Two metrics and two versions added to the catalogue, in one aggregation with all of its own."""
    catalogue = (
        evaluation.Catalogue()
        .with_metric(evaluation.added_portion(evaluation.Metric("not_longer", "Not longer", "portion"), lambda: F.length("hyp") <= F.length("tgt")))
        .with_metric(evaluation.added_mean(evaluation.Metric("length_ratio", "Length ratio", "float", 3, None), lambda: F.length("hyp") / F.length("tgt")))
        .with_version("large", lambda: F.col("p_size") > 25)
        .with_version("pointers", lambda: F.contains("tgt", F.lit("*")))
    )
    summary = catalogue.summarise(catalogue.in_versions(_measured(spark, sf_dir, *evaluation.SUMMARISED)), ["version", "system"])
    return summary.select("version", "system", "not_longer.correct", "not_longer.total", F.round("length_ratio", 6).alias("length_ratio"), F.round(evaluation.ratio(F.col("exact_match")), 6).alias("exact_match"))


RETURNS = "['int', 'static char *', 'void', 'int'][form + 1]"
ARGS = case(["", "const char *:bufZ/1|int:n/0", "int ( * ) ( int ):cbZ/1|unsigned long [ ]:v/0", "int:a/0|char *:bZ/1"])
SWAPPED_ARGS = case(["", "int:n/0|const char *:bufZ/1", "unsigned long [ ]:v/0|int ( * ) ( int ):cbZ/1", "char *:bZ/1|int:a/0"])


@query(
    f"""WITH {ROWS} SELECT p_partkey AS idx, system, system <> 'cut' AS parsable, CASE WHEN system = 'cut' THEN '' ELSE 'f' || p_partkey END AS name, CASE WHEN system = 'cut' THEN '' ELSE {RETURNS} END AS ret_type,
    CASE system WHEN 'cut' THEN '' WHEN 'same' THEN {ARGS} ELSE {SWAPPED_ARGS} END AS args FROM code"""
)
def func_signature(spark, sf_dir):
    sig = _rows(spark, sf_dir).select("idx", "system", clang.signature_column(False)("hyp").alias("s"))
    args = F.array_join(F.transform("s.args", lambda a: F.concat(F.array_join(a["type"], " "), F.lit(":"), a["name"], F.lit("/"), a["pointer_layer"].cast("string"))), "|")
    return sig.select("idx", "system", "s.parsable", "s.name", F.array_join("s.ret_type.type", " ").alias("ret_type"), args.alias("args"))


@query(
    f"""WITH {ROWS} SELECT p_partkey AS idx, system, CASE WHEN system = 'cut' OR form = 0 THEN '' WHEN {SWAP} THEN '1,0' ELSE '0,1' END AS match_idx,
    CASE WHEN system = 'cut' AND form > 0 THEN '0,1' ELSE '' END AS missing_args FROM code"""
)
def arg_matching(spark, sf_dir):
    """Which target parameter each one of a hypothesis stands for, whatever their order."""
    line = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _measured(spark, sf_dir, "match_idx", "missing_args").select("idx", "system", line("match_idx"), line("missing_args"))


#: Of declarations that are no pointers in the source: return types and, by form, one parameter that becomes a pointer and one that doesn't.
POINTERS = """CASE WHEN system = 'cut' THEN 0 ELSE [0, 2, 1, 1][form + 1] END AS tp, 0 AS fp, CASE WHEN system = 'cut' THEN [0, 1, 0, 0][form + 1] ELSE 0 END AS fn,
  CASE WHEN system = 'cut' THEN [1, 0, 1, 1][form + 1] ELSE [1, 1, 2, 2][form + 1] END AS tn"""


@query(f"WITH {ROWS} SELECT p_partkey AS idx, system, {POINTERS} FROM code")
def pointer_conversion(spark, sf_dir):
    return _measured(spark, sf_dir, "pointer_conversion").select("idx", "system", *(F.col(f"pointer_conversion.{c}").cast("int").alias(c) for c in evaluation.CONFUSION))


PRETTY = (
    "int fK(void) {\n  count = Z;\n  return count;\n}", 'static char * fK(const char * bufZ, int n) {\n  puts("xZ");\n  return bufZ;\n}', "void fK(int (* cbZ)(int), unsigned long v[Z]) {\n  cbZ(v[0]);\n}",
    "int fK(a, bZ) int a;\nchar * bZ;\n{\n  if (!a) {\n    bZ ++;\n  } else {\n    a = Z;\n  }\n  return a;\n}",
)


@query(f"SELECT p_partkey AS idx, {case(PRETTY)} AS code FROM part")
def prettify(spark, sf_dir):
    return _rows(spark, sf_dir).where("system = 'same'").select("idx", clang.pretty("tgt").alias("code"))


SOURCE_WORDS = f"src_words AS (SELECT unnest(string_split({SOURCE}, ' ')) AS value FROM part)"


@query(
    f"""WITH {SOURCE_WORDS}, i AS (SELECT value FROM src_words WHERE value NOT IN ({KEYWORD_LIST}) AND regexp_full_match(value, '[A-Za-z]\\w*'))
    SELECT word, count(*) AS count FROM (SELECT value AS word FROM i UNION ALL SELECT 's' FROM i WHERE value = 'v1') GROUP BY word"""
)
def identifier_tokens(spark, sf_dir):
    """Identifiers of the sources; the one variable counts under both of its names."""
    lexed = _rows(spark, sf_dir).where("system = 'same'").select(clang.lexed("src").alias("t"), "var_names")
    return corpus.identifier_counts(lexed, "t", "var_names")


CODE_PAIRS = f"{ROWS}, pairs AS (SELECT p_partkey * 3 + list_position(['same', 'swapped', 'cut'], system) - 1 AS idx, tgt, hyp AS src FROM code)"
ANONYMOUS = """regexp_replace(regexp_replace({0}, '(^| )(f[0-9]+|count|buf[0-9]+|n|puts|cb[0-9]+|v|a|b[0-9]+)( |$)', '\\1_VAR_\\3', 'g'), '(^| )(f[0-9]+|count|buf[0-9]+|n|puts|cb[0-9]+|v|a|b[0-9]+)( |$)', '\\1_VAR_\\3', 'g')"""


def corpus_score(order: int, name: str, pairs: str) -> str:
    """A subquery ``system, name``: the corpus score of a system."""
    sums = ", ".join(f"sum(m{n}) AS m{n}, sum(p{n}) AS p{n}" for n in range(1, order + 1))
    inner = bleu_sql(order).replace(PAIRS, pairs)
    return f"(WITH {inner}, t AS (SELECT idx % 3 AS s, sum(h) AS h, sum(r) AS r, {sums} FROM k GROUP BY ALL) SELECT ['same', 'swapped', 'cut'][s + 1] AS system, '{name}' AS metric, round({score_sql(order, False)}, 6) AS value FROM t)"


MEAN = f"(WITH {bleu_sql(4).replace(PAIRS, CODE_PAIRS)}, b AS (SELECT idx % 3 AS s, {score_sql(4, True)} AS x FROM k) SELECT ['same', 'swapped', 'cut'][s + 1] AS system, 'bleu4_sent' AS metric, round(avg(x), 6) AS value FROM b GROUP BY s)"
NO_VAR_PAIRS = CODE_PAIRS.replace("AS idx, tgt, hyp AS src FROM code)", f"AS idx, {ANONYMOUS.format('tgt')} AS tgt, {ANONYMOUS.format('hyp')} AS src FROM code)")
PART_SUMS = f"""WITH {ROWS}, x AS (SELECT system, form, p_size, {POINTERS}, {N_ARGS} AS n, system <> 'cut' AS ok, CAST(form = 1 AS INTEGER) AS strings FROM code),
  s AS (SELECT system, CAST(sum(CAST(system = 'same' OR (system = 'swapped' AND form = 0) AS INTEGER)) AS DOUBLE) / count(*) AS exact_match, avg(p_size / 100) AS overlap_score, 1 - sum(CAST(ok AS INTEGER)) / count(*) AS unparsable,
    sum(CAST(ok AS INTEGER)) / count(*) AS func_name, sum(CAST(ok AS INTEGER)) / count(*) AS ret_type, sum(CAST(ok AS INTEGER)) / count(*) AS ret_type_strict, sum(CASE WHEN ok THEN n ELSE 0 END) / sum(n) AS arg_name,
    sum(CASE WHEN ok THEN n ELSE 0 END) / sum(n) AS arg_type, sum(CASE WHEN ok THEN n ELSE 0 END) / sum(n) AS arg_type_strict, sum(CASE WHEN ok THEN 0 ELSE n END) / sum(n) AS arg_missing, CAST(0 AS DOUBLE) AS arg_redundant,
    sum(CASE WHEN ok THEN 0 ELSE strings END) / sum(strings) AS str_missing, CAST(0 AS DOUBLE) AS str_redundant, 2 * sum(tp) / greatest(1, 2 * sum(tp) + sum(fp) + sum(fn)) AS pointer_conversion FROM x GROUP BY system)
SELECT system, metric, round(value, 6) AS value FROM (SELECT system, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in ('exact_match', 'overlap_score', 'unparsable', 'func_name', 'ret_type', 'ret_type_strict', 'arg_name', 'arg_type', 'arg_type_strict', 'arg_missing', 'arg_redundant', 'str_missing', 'str_redundant', 'pointer_conversion'))} FROM s)
  UNPIVOT (value FOR metric IN (exact_match, overlap_score, unparsable, func_name, ret_type, ret_type_strict, arg_name, arg_type, arg_type_strict, arg_missing, arg_redundant, str_missing, str_redundant, pointer_conversion))"""


@query(f"SELECT * FROM ({PART_SUMS}) UNION ALL SELECT * FROM {MEAN} UNION ALL SELECT * FROM {corpus_score(4, 'bleu4', CODE_PAIRS)} UNION ALL SELECT * FROM {corpus_score(8, 'bleu8', CODE_PAIRS)} UNION ALL SELECT * FROM {corpus_score(4, 'bleu4_no_var', NO_VAR_PAIRS)}")
def signature_summary(spark, sf_dir):
    """All eighteen metrics by system, in long form."""
    summary = evaluation.summarise(_measured(spark, sf_dir, *evaluation.SUMMARISED), ["system"])
    return evaluation.long_metrics(summary, ["system"], [m.key for m in evaluation.METRICS]).select("system", "metric", F.round("value", 6).alias("value"))


@query(
    f"""WITH {ROWS} SELECT p_partkey AS "index", system, 18 AS n_metrics, 3 AS n_systems, 'f' || p_partkey AS target_name, {RETURNS} AS target_type, CASE WHEN system = 'cut' THEN '' ELSE 'f' || p_partkey END AS name,
    CAST(CASE WHEN system = 'cut' THEN 0 ELSE {N_ARGS} END AS BIGINT) AS n_args, md5(tgt) AS sha FROM code"""
)
def report_json(spark, sf_dir):
    """The report as gzip members of one JSON document, written and read back by example."""
    path, measured = scratch(spark, "report"), pinned(_measured(spark, sf_dir), "measured")
    systems = evaluation.summarise(measured, ["system"]).withColumnRenamed("system", "key")
    examples = report.example_rows(measured, "decompiled")
    sinks.write_report(report.document(examples, systems), path)
    head = readers.report_head(spark, path).select(F.size("metrics").alias("m"), F.size("systems").alias("s")).first()
    found = readers.report_examples(spark, path, examples.schema)
    each = F.inline(F.array(*[F.struct(F.lit(s).alias("system"), F.col("predictions")[s]["func_name"].alias("name"), F.size(F.col("predictions")[s]["args"]).cast("long").alias("n_args")) for s in SYSTEMS]))
    told = (F.lit(head.m).alias("n_metrics"), F.lit(head.s).alias("n_systems"))
    return found.select("index", *told, F.col("target.func_name").alias("target_name"), F.col("target.ret_type").alias("target_type"), F.col("meta_data.sha").alias("sha"), each)
