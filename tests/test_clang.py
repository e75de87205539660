import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import clang as c
from seqloom.functions.clang import Declared, Signature
from seqloom.operators import evaluation as e


def sig(code, strict=True):
    return c.parsed(code.split(), strict)


def args(code):
    return [(" ".join(a.type), a.name, a.pointer_layer) for a in sig(code)[0].args]


def test_lexer():
    assert c.lex('static int x1 = 0x1F + 07 + 10u + 1.5e3f; // c\n/* d */ L"w" "s\\"t" \'a\' <unk> ... ->') == [
        ("STATIC", "static"), ("INT", "int"), ("ID", "x1"), ("SYMBOL", "="), ("INT_CONST_HEX", "0x1F"), ("SYMBOL", "+"), ("INT_CONST_OCT", "07"), ("SYMBOL", "+"), ("INT_CONST_DEC", "10u"), ("SYMBOL", "+"), ("FLOAT_CONST", "1.5e3f"),
        ("SYMBOL", ";"), ("WSTRING_LITERAL", 'L"w"'), ("STRING_LITERAL", '"s\\"t"'), ("CHAR_CONST", "'a'"), ("ID", "__unk__"), ("SYMBOL", "..."), ("SYMBOL", "->"),
    ]
    assert c.values("a @ ` b") == ["a", "b"] and c.lex("") == []


def test_signatures():
    s, ok = sig("int f ( void ) { }")
    assert ok and s == Signature(Declared(("int",), 0, "f"), ())
    code = "static char * g ( const char * s , int n ) { return s ; }"
    assert sig(code)[0].returns == Declared(("static", "char", "*"), 1, "g")
    assert args(code) == [("const char *", "s", 1), ("int", "n", 0)]
    assert args("int h ( a , b ) int a ; char * b ; { }") == [("int", "a", 0), ("char *", "b", 1)]
    assert args("int k ( int v [ 10 ] , ... ) { }") == [("int [ ]", "v", 0), ("...", "...", 0)]
    assert [(a[1], a[2]) for a in args("void m ( int ( * cb ) ( int ) ) { }")] == [("cb", 1)]
    assert sig("int x ;") == (c.EMPTY, False) and sig("") == (c.EMPTY, False)
    assert sig("f ( int a ) { }")[0].returns == Declared(("void",), 0, "f")
    assert args("int f ( int , long n ) { }") == [("", "int", 0), ("long", "n", 0)]  # a keyword counts as a name
    assert not sig("int f ( int a { }")[1]
    broken = "int f ( int a ) { if ( a ) { return"
    assert not sig(broken)[1] and sig(broken, strict=False)[1]
    assert args("int f ( struct { int a , b ; } s , int t ) { }")[1] == ("int", "t", 0)


def test_prettify():
    code = 'int main ( void ) { for ( i = 0 ; i < 3 ; i ++ ) { a [ i ] = * p ; } if ( ! x ) { f ( 1 , 2 ) ; } else { y . z = ** q ; } }'.split()
    assert c.prettify(code).split("\n") == [
        "int main(void) {", "  for (i = 0; i < 3; i ++) {", "    a[i] = * p;", "  }", "  if (!x) {", "    f(1, 2);", "  } else {", "    y.z = ** q;", "  }", "}",
    ]
    assert c.prettify([]) == ""


def declared(text):
    *kind, name = text.split()
    return Declared(tuple(kind), kind.count("*"), name)


def test_matching():
    n, size = declared("int n"), declared("size_t len")
    assert e.confidence(n, 0, n, 0) == 1.0 and e.confidence(n, 0, n, 1) == pytest.approx(0.95)
    assert e.confidence(n, 0, size, 1) == pytest.approx(0.283333, abs=1e-6)
    hyp = Signature(declared("int f"), (declared("int n"), declared("char * buf")))
    tgt = Signature(declared("int f"), (declared("char * buf"), declared("int n"), declared("int flags")))
    assert e.matched(hyp, tgt) == ([1, 0], [1, 0, None])
    m = e.measured(tgt, tgt, hyp, [0, 1, 2])
    assert m["arg_missing"] == {"correct": 1.0, "total": 3} and m["arg_redundant"] == 0
    costs = np.array([[1 - e.confidence(a, i, b, j) for j, b in enumerate(tgt.args)] for i, a in enumerate(hyp.args)])
    assert costs[0, 1] + costs[1, 0] == pytest.approx(0.10)
    assert e.matched(c.EMPTY, tgt) == ([], [None] * 3)


def test_pointers():
    src, tgt = sig("int f ( int p ) { }")[0], sig("int f ( char * p ) { }")[0]
    m = e.measured(src, tgt, tgt, [0])["pointer_conversion"]
    assert m == {"tp": 1, "fp": 0, "fn": 0, "tn": 1}  # the argument, and the return type
    assert e.measured(tgt, tgt, tgt, [0])["pointer_conversion"]["tp"] == 0  # a pointer already


def test_summary_and_report(spark):
    import json

    from seqloom.operators import report
    from tests import code_examples as q

    rows = {(r.system, r.metric): r.value for r in q.signature_summary(spark, "").collect()}
    assert rows["good", "exact_match"] == 0 and rows["bad", "unparsable"] == pytest.approx(1 / 3) and rows["good", "unparsable"] == 0
    assert rows["good", "bleu4"] > rows["bad", "bleu4"] > 0 and rows["good", "str_missing"] == 0 and rows["bad", "str_missing"] == 1
    assert rows["good", "pointer_conversion"] > rows["bad", "pointer_conversion"]
    lines = [r.line for r in q.report_json(spark, "").orderBy("ordinal").collect()]
    doc = json.loads("".join(lines))
    assert len(doc["metrics"]) == 18 and [s["key"] for s in doc["systems"]] == ["bad", "decompiled", "good"] and len(doc["examples"]) == 3
    good = doc["examples"][1]["predictions"]["good"]
    assert [a["match_idx"] for a in good["args"]] == [1, 0] and good["missing_args"] == [] and doc["examples"][0]["var_map"]["v1"]["orig"] == "s"
    assert doc["examples"][0]["predictions"]["decompiled"]["code"].startswith("int f(void) {")
    summary = [r.asDict(True) for r in e.summarise(q._measured(spark), ["system"]).collect()]
    table = report.summary_table(summary)
    assert table.count("\n") == 18 and "\033" in report.summary_table(summary, True)
    versions = e.with_versions(q._measured(spark), "idx", F.lit(20))
    assert e.summarise(versions, ["version", "system"]).count() == 9
    best = {r.metric: r for r in e.best_worst(e.long_metrics(e.summarise(q._measured(spark), ["system"]), ["system"], ["bleu4", "str_missing", "overlap_score"]), ("decompiled",)).collect()}
    assert best["bleu4"].best > best["bleu4"].worst and best["str_missing"].best < best["str_missing"].worst and best["overlap_score"].best is None
