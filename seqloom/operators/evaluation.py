"""Evaluation of translations: one row of metrics for each example and system, then additive aggregates.

``measure`` computes everything that needs code to be lexed, parsed and matched in one Arrow function, once a row, whatever the
number of evaluation versions a row belongs to. All that follows is sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seqloom.functions import bleu, clang
from seqloom.functions.assignment import assign
from seqloom.functions.sequences import similarity
from seqloom.functions.slices import row_by_row
from seqloom.functions.text import ALWAYS_DROPPED, CV_QUALIFIERS, STORAGE_QUALIFIERS
from seqloom.operators.corpus import ranged
from seqloom.sources.workspace import spare


@dataclass(frozen=True)
class Metric:
    key: str
    name: str
    type: str
    fixed: int | None = None
    higher_is_better: bool | None = True
    display_in_summary: bool = True
    display_in_example: bool = False


#: The catalogue of metrics, in report order.
METRICS = (
    Metric("bleu4", "BLEU4", "float", 2, display_in_example=True),
    Metric("bleu4_sent", "Sent BLEU4", "float", 2),
    Metric("bleu8", "BLEU8", "float", 2, display_in_example=True),
    Metric("bleu4_no_var", "BLEU4 (ignoring identifiers)", "float", 2, display_in_example=True),
    Metric("exact_match", "Exact match", "portion", 4, display_in_example=True),
    Metric("overlap_score", "Similarity score", "float", 3, None, False, True),
    Metric("unparsable", "Unparsable function signature", "portion", None, False),
    Metric("func_name", "Correct function names", "portion"),
    Metric("ret_type", "Correct return types (ignoring CV)", "portion"),
    Metric("ret_type_strict", "Correct return types (strict)", "portion"),
    Metric("arg_name", "Correct argument names", "portion"),
    Metric("arg_type", "Correct argument types (ignoring CV)", "portion"),
    Metric("arg_type_strict", "Correct argument types (strict)", "portion"),
    Metric("arg_missing", "Missing arguments", "portion", None, False),
    Metric("arg_redundant", "Redundant arguments", "int", None, False),
    Metric("str_missing", "Missing string literals", "portion", None, False),
    Metric("str_redundant", "Redundant string literals", "int", None, False),
    Metric("pointer_conversion", "Pointer conversion", "confusion_mat"),
)
PORTIONS = ("exact_match", "unparsable", "func_name", "ret_type", "ret_type_strict", "arg_name", "arg_type", "arg_type_strict", "arg_missing", "str_missing")
INTS = ("arg_redundant", "str_redundant")
CONFUSION = ("tp", "fp", "fn", "tn")
BLEU_DDL = "struct<matches:array<bigint>,possible:array<bigint>,hyp_len:bigint,ref_len:bigint>"
ROW_DDL = ", ".join(
    [*(f"{p} struct<correct:double,total:bigint>" for p in PORTIONS), *(f"{i} bigint" for i in INTS), "pointer_conversion struct<tp:bigint,fp:bigint,fn:bigint,tn:bigint>", f"counts {BLEU_DDL}", f"counts_no_var {BLEU_DDL}",
     "match_idx array<int>", "arg_names array<double>", "arg_types array<double>", "missing_args array<int>", "missing_strings array<string>", "redundant_strings array<string>"]
)


DROPPED = {strict: frozenset((*ALWAYS_DROPPED, *STORAGE_QUALIFIERS, *(() if strict else CV_QUALIFIERS))) for strict in (True, False)}


def compared_type(d: clang.Declared, strict: bool) -> str:
    return " ".join([t for t in d.type if t not in DROPPED[strict]])


@lru_cache(maxsize=100_000)
def _likeness(a: str, b: str) -> float:
    return similarity(a, b)


def _alike(a: str, b: str) -> float:
    return 1.0 if a == b else _likeness(a, b)


def confidence(a: clang.Declared, i: int, b: clang.Declared, j: int) -> float:
    """How alike two arguments are: names more than types, less for a different place."""
    return 0.3 * _alike(" ".join(a.type), " ".join(b.type)) + 0.7 * _alike(a.name, b.name) - 0.05 * abs(i - j)


def matched(left: clang.Signature, right: clang.Signature) -> tuple[list[int | None], list[int | None]]:
    """The best pairing of two signatures' arguments, from both sides."""
    if not left.args or not right.args:
        return [None] * len(left.args), [None] * len(right.args)
    return assign(np.array([[1 - confidence(a, i, b, j) for j, b in enumerate(right.args)] for i, a in enumerate(left.args)]))


def pointer_counts(facts: list[tuple[clang.Declared, clang.Declared, clang.Declared]]) -> dict[str, int]:
    """Of declarations that are no pointers in the source: whether target and hypothesis make them one."""
    became = [(t.pointer_layer > 0, h.pointer_layer > 0) for s, t, h in facts if not s.pointer_layer]
    return {name: became.count(pair) for name, pair in zip(CONFUSION, ((True, True), (False, True), (True, False), (False, False)), strict=True)}


def portion(correct: float, total: int) -> dict:
    return {"correct": float(correct), "total": total}


def likeness(want: clang.Declared | None, have: clang.Declared) -> dict[str, float]:
    """How well a declaration agrees with the one wanted, by what is looked at; nothing agrees with nothing."""
    if want is None:
        return {"name": 0.0, "type": 0.0, "strict": 0.0}
    by_type = lambda strict: _alike(compared_type(want, strict), compared_type(have, strict))
    return {"name": _alike(want.name, have.name), "type": by_type(False), "strict": by_type(True)}


def paired(src: clang.Signature, tgt: clang.Signature, hyp: clang.Signature, tgt_to_src: list[int | None]) -> dict:
    """What follows from which target's argument each of a hypothesis stands for."""
    hyp_to_tgt, tgt_to_hyp = matched(hyp, tgt)
    in_all_three = {tgt.args[t].name: (src.args[tgt_to_src[t]], tgt.args[t], h) for h, t in zip(hyp.args, hyp_to_tgt, strict=True) if t is not None and tgt_to_src[t] is not None}
    missing = [j for j, i in enumerate(tgt_to_hyp) if i is None]
    return {
        "arg_missing": portion(len(missing), len(tgt.args)), "arg_redundant": hyp_to_tgt.count(None), "pointer_conversion": pointer_counts([(src.returns, tgt.returns, hyp.returns), *in_all_three.values()]),
        "match_idx": hyp_to_tgt, "missing_args": missing,
    }


def agreeing(tgt: clang.Signature, hyp: clang.Signature, hyp_to_tgt: list[int | None]) -> dict:
    """How far a hypothesis agrees with its target, argument by argument and in its name and return type."""
    args = [likeness(None if t is None else tgt.args[t], h) for h, t in zip(hyp.args, hyp_to_tgt, strict=True)]
    whole = likeness(tgt.returns, hyp.returns)
    each = lambda what: [a[what] for a in args]
    of_args = lambda correct: portion(correct, len(tgt.args))
    return {
        "func_name": portion(whole["name"], 1), "ret_type": portion(whole["type"], 1), "ret_type_strict": portion(whole["strict"], 1),
        "arg_name": of_args(sum(each("name"))), "arg_type": of_args(sum(each("type"))), "arg_type_strict": of_args(sum(each("strict"))), "arg_names": each("name"), "arg_types": each("type"),
    }


def measured(src: clang.Signature, tgt: clang.Signature, hyp: clang.Signature, tgt_to_src: list[int | None]) -> dict:
    """Signature metrics of one hypothesis, from its arguments beside the targets' that they were matched to."""
    pairs = paired(src, tgt, hyp, tgt_to_src)
    return pairs | agreeing(tgt, hyp, pairs["match_idx"])


@dataclass(frozen=True)
class Code:
    """What a text of code holds: its tokens, those with identifiers all alike, and its string literals; n-grams are counted once."""

    tokens: bleu.Grams
    nameless: bleu.Grams
    strings: set[str]


#: Texts that a task remembers: the rows of an example come side by side, with the same source and target.
REMEMBERED = 8


@lru_cache(maxsize=REMEMBERED)
def _lexed(text: str) -> list[tuple[str, str]]:
    return clang.lex(text)


@lru_cache(maxsize=REMEMBERED)
def _code(text: str) -> Code:
    lexed = _lexed(text)
    return Code(bleu.Grams([v for _, v in lexed]), bleu.Grams(["_VAR_" if t == "ID" else v for t, v in lexed]), {v for t, v in lexed if t in ("STRING_LITERAL", "WSTRING_LITERAL")})


@lru_cache(maxsize=REMEMBERED)
def _signature(text: str, strict: bool) -> tuple[clang.Signature, bool]:
    return clang.parsed([v for _, v in _lexed(text)], strict)


@lru_cache(maxsize=REMEMBERED)
def _to_source(src: clang.Signature, tgt: clang.Signature) -> list[int | None]:
    return matched(src, tgt)[1]


def _of_texts(tgt: Code, hyp: Code) -> dict:
    """What tokens and string literals tell."""
    want, have = tgt.strings, hyp.strings
    counts = lambda a, b, n: dict(zip(("matches", "possible", "hyp_len", "ref_len"), bleu.counts_of(a, b, n), strict=True))
    return {
        "exact_match": portion(tgt.tokens.tokens == hyp.tokens.tokens, 1), "str_missing": portion(len(want - have), len(want)), "str_redundant": len(have - want),
        "counts": counts(tgt.tokens, hyp.tokens, 8), "counts_no_var": counts(tgt.nameless, hyp.nameless, 4), "missing_strings": sorted(want - have), "redundant_strings": sorted(have - want),
    }


#: What ``summarise`` reads of the metric columns.
SUMMARISED = (*PORTIONS, *INTS, "pointer_conversion", "counts", "counts_no_var")
#: Metric columns by what they take beside the pairing of arguments.
AGREEMENT = frozenset(("func_name", "ret_type", "ret_type_strict", "arg_name", "arg_type", "arg_type_strict", "arg_names", "arg_types"))
OF_TEXTS = frozenset(("exact_match", "str_missing", "str_redundant", "counts", "counts_no_var", "missing_strings", "redundant_strings"))


def measure_row(src: str, tgt: str, hyp: str, baseline: bool, only: frozenset[str] = AGREEMENT | OF_TEXTS) -> dict:
    """All metrics of one hypothesis, or those that ``only`` needs. ``src`` has its variables replaced; the baseline's hypothesis is that
    source itself."""
    src_sig, tgt_sig, (hyp_sig, ok) = _signature(src, True)[0], _signature(tgt, True)[0], _signature(hyp, baseline)
    out = paired(src_sig, tgt_sig, hyp_sig, _to_source(src_sig, tgt_sig)) | {"unparsable": portion(not ok, 1)}
    if not only.isdisjoint(AGREEMENT):
        out |= agreeing(tgt_sig, hyp_sig, out["match_idx"])
    return out if only.isdisjoint(OF_TEXTS) else out | _of_texts(_code(tgt), _code(hyp))


def measure(rows: DataFrame, src: Column, tgt: Column, hyp: Column, baseline: Column, only: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the metric columns of each hypothesis (null texts count as empty), or with those named by ``only``: what just the others
    need is left out."""
    fields = [x for x in ROW_DDL.split(", ") if not only or x.split(" ")[0] in only]
    names = frozenset(x.split(" ")[0] for x in fields)
    if unknown := set(only) - names:
        raise ValueError(f"no such metric columns: {sorted(unknown)}")
    kind = pa.struct(list(to_arrow_schema(T.StructType.fromDDL(", ".join(fields)))))

    @F.arrow_udf(f"struct<{', '.join(x.replace(' ', ':', 1) for x in fields)}>")
    def column(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield row_by_row(lambda s, t, h, b: measure_row(s or "", t or "", h or "", bool(b), names), kind, *batch)

    (m,) = spare(rows, "measured")
    out = rows.withColumn(m, column(src, tgt, hyp, baseline)).select(*rows.columns, f"{m}.*")
    sentence = {"bleu4": ("counts", 4), "bleu8": ("counts", 8), "bleu4_no_var": ("counts_no_var", 4)}
    return out.withColumns({k: bleu.sentence(F.col(c), n) for k, (c, n) in sentence.items() if c in names})


@dataclass(frozen=True)
class Added:
    """A metric of one's own: its value of a row, its sums over rows, and its final value from them.

    ``value`` makes a column from the columns of measured rows; ``sums`` make aggregates of it, by name; ``final`` makes the metric from the
    sums' columns. Types are those of the catalogue; a portion is a struct of ``correct`` and ``total``.
    """

    metric: Metric
    value: Callable[[], Column]
    sums: dict[str, Callable[[Column], Column]]
    final: Callable[[dict[str, Column]], Column]


def added_mean(metric: Metric, value: Callable[[], Column]) -> Added:
    """The mean of a row's value."""
    return Added(metric, value, {"mean": F.avg}, lambda sums: sums["mean"])


def added_portion(metric: Metric, test: Callable[[], Column]) -> Added:
    """How many rows pass a test (null: no row of it)."""
    count = {"correct": lambda v: F.coalesce(F.sum(v.cast("long")), F.lit(0)), "total": F.count}
    return Added(metric, test, count, lambda sums: F.struct(sums["correct"].alias("correct"), sums["total"].alias("total")))


@dataclass(frozen=True)
class Catalogue:
    """The metrics and evaluation versions of a report: the library's, and what is added to them.

    A version is a name and a test of measured rows; every row is in the version ``eval`` besides.
    """

    added: tuple[Added, ...] = ()
    versions: tuple[tuple[str, Callable[[], Column]], ...] = ()

    def with_metric(self, added: Added) -> Catalogue:
        if added.metric.key in {m.key for m in self.metrics()}:
            raise ValueError(f"there is a metric {added.metric.key!r}")
        return replace(self, added=(*self.added, added))

    def with_version(self, name: str, test: Callable[[], Column]) -> Catalogue:
        if name in {"eval", *(n for n, _ in self.versions)}:
            raise ValueError(f"there is a version {name!r}")
        return replace(self, versions=(*self.versions, (name, test)))

    def metrics(self) -> tuple[Metric, ...]:
        return (*METRICS, *(a.metric for a in self.added))

    def in_versions(self, measured_rows: DataFrame, name: str = "version") -> DataFrame:
        """Each row once for every version it belongs to, so that one aggregation serves all."""
        held = F.array_compact(F.array(F.lit("eval"), *(F.when(test(), F.lit(n)) for n, test in self.versions)))
        return measured_rows.withColumn(name, F.explode(held))

    def summarise(self, measured_rows: DataFrame, by: list[str]) -> DataFrame:
        return summarise(measured_rows, by, self.added)


def summarise(measured_rows: DataFrame, by: list[str], added: tuple[Added, ...] = ()) -> DataFrame:
    """One row a group with all metrics; BLEU of the whole group, the overlap's mean, portions and confusions summed. Whatever is added is
    part of the same aggregation."""
    sums = [*bleu.corpus_sums(F.col("counts"), 8, "b"), *bleu.corpus_sums(F.col("counts_no_var"), 4, "v"), F.avg("bleu4").alias("bleu4_sent"), F.avg("overlap_score").alias("overlap_score"), F.count("*").alias("n_examples")]
    sums += [F.struct(F.sum(f"{p}.correct").alias("correct"), F.sum(f"{p}.total").alias("total")).alias(p) for p in PORTIONS]
    sums += [F.sum(i).alias(i) for i in INTS]
    sums += [F.struct(*(F.sum(f"pointer_conversion.{c}").alias(c) for c in CONFUSION)).alias("pointer_conversion")]
    sums += [F.struct(*(f(a.value()).alias(n) for n, f in a.sums.items())).alias(a.metric.key) for a in added]
    out = measured_rows.groupBy(*by).agg(*sums)
    scores = {"bleu4": bleu.corpus("b", 4), "bleu8": bleu.corpus("b", 8), "bleu4_no_var": bleu.corpus("v", 4)}
    own = {a.metric.key: a.final({n: F.col(f"`{a.metric.key}`.`{n}`") for n in a.sums}) for a in added}
    return out.withColumns(scores).select(*by, "n_examples", *(m.key for m in METRICS), *(c.alias(k) for k, c in own.items()))


def ratio(portion: Column) -> Column:
    return F.try_divide(portion["correct"], portion["total"])


def confusion(gold: Column, pred: Column) -> list[Column]:
    """Counts of both booleans' four combinations."""
    return [F.count_if(gold & pred).alias("tp"), F.count_if(~gold & pred).alias("fp"), F.count_if(gold & ~pred).alias("fn"), F.count_if(~gold & ~pred).alias("tn")]


def confusion_scores(df: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall and F1 (null where undefined; F1 is 0 without positives)."""
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return df.withColumns(
        {
            "accuracy": F.try_divide(F.col("tp") + F.col("tn"), total), "precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")),
            "f1": 2 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        }
    )


#: Distinct values with their counts that one task may sort (a few MB); more are dealt by range.
RANKED_VALUES = 200_000


def percentile_cuts(df: DataFrame, value: str, shares: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """One row: exact, linearly interpolated cuts and, as upper edge, the largest value plus one; null cuts without values.

    Equal values are counted before anything is sorted. A few distinct ones are ranked at once; many are dealt by range and their
    counts summed within and over ranges. Then each cut is looked up between two ranks. No task holds more than a range.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    few = counted.limit(RANKED_VALUES + 1).collect()
    if len(few) > RANKED_VALUES:
        return _cut(df, *_ranked(counted), shares)
    few.sort(key=lambda r: r.v)
    stops = np.cumsum([r.n for r in few]) if few else np.zeros(1, np.int64)
    return _cut(df, int(stops[-1]), few[-1].v if few else None, lambda ranks: {r: float(few[int(np.searchsorted(stops, r, "right"))].v) for r in ranks}, shares)


def _ranked(counted: DataFrame) -> tuple:
    """How many values there are, the largest one, and a function from ranks to values."""
    rows = ranged(counted, [F.col("v")], "part", "place")
    whole = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("v").alias("high")).first()
    here = Window.partitionBy("part").orderBy("place")
    sizes = rows.groupBy("part").agg(F.sum("n").alias("size"))
    shift = sizes.select("part", (F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("size")).alias("before"))  # a row a range
    placed = rows.withColumn("stop", F.sum("n").over(here)).join(F.broadcast(shift), "part").select("v", (F.col("before") + F.col("stop") - F.col("n")).alias("first"), (F.col("before") + F.col("stop") - 1).alias("last"))

    def of(ranks: list[int]) -> dict[int, float]:
        at = placed.select("v", F.explode(F.filter(F.array(*[F.lit(r) for r in ranks]), lambda r: r.between(F.col("first"), F.col("last")))).alias("rank"))
        return {r.rank: float(r.v) for r in at.collect()}  # two rows a cut

    return whole.n, whole.high, of


def _cut(df: DataFrame, n: int, high, value_at, shares: tuple[float, ...]) -> DataFrame:
    ranks = [share * max(n - 1, 0) for share in shares]
    found = value_at(sorted({r for x in ranks for r in (math.floor(x), math.ceil(x))})) if n else {}
    cuts = [found[math.floor(x)] + (x - math.floor(x)) * (found[math.ceil(x)] - found[math.floor(x)]) for x in ranks] + [float(high + 1)] if n else [None] * (len(shares) + 1)
    return df.sparkSession.createDataFrame([(cuts,)], "cuts array<double>")


def percentile_bin(value: Column, cuts: Column, step: int = 20) -> Column:
    """The label of the half-open bin that holds a value: ``step``, twice ``step``, ...; null if there is none."""
    below = F.size(F.filter(cuts, lambda c: c <= value))
    return F.when((below > 0) & (below < F.size(cuts)), below * step)


def with_versions(df: DataFrame, index: str, bin_label: Column, small: int = 50) -> DataFrame:
    """Each row once for every evaluation version it belongs to, so that one aggregation serves all."""
    versions = F.array_compact(F.array(F.when(F.col(index) < small, F.lit("eval-small")), F.lit("eval"), F.when(bin_label.isNotNull(), F.concat(F.lit("eval-"), bin_label.cast("string")))))
    return df.withColumn("version", F.explode(versions))


def long_metrics(summary: DataFrame, by: list[str], keys: list[str], metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """``by, metric, value``: portions as ratios, confusions as F1."""
    kinds = {m.key: m.type for m in metrics}
    f1 = lambda k: 2 * F.col(f"{k}.tp") / F.greatest(F.lit(1), 2 * F.col(f"{k}.tp") + F.col(f"{k}.fp") + F.col(f"{k}.fn"))
    value = {"portion": lambda k: ratio(F.col(k)), "confusion_mat": f1}
    cells = [F.struct(F.lit(k).alias("metric"), value.get(kinds.get(k, "float"), F.col)(k).cast("double").alias("value")) for k in keys]
    return summary.select(*by, F.inline(F.array(*cells)))


def pivoted(long: DataFrame, systems: list[str], by: str = "metric") -> DataFrame:
    return long.groupBy(by).pivot("system", systems).agg(F.first("value"))


def best_worst(long: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """``metric, best, worst`` over systems that aren't excluded; none where no direction is better."""
    better = F.create_map(*[F.lit(x) for m in METRICS if m.higher_is_better is not None for x in (m.key, m.higher_is_better)])
    rows = long.where(~F.col("system").isin(list(excluded))) if excluded else long
    out = rows.groupBy("metric").agg(F.max("value").alias("high"), F.min("value").alias("low"))
    up = better[F.col("metric")]
    return out.select("metric", F.when(up, F.col("high")).when(~up, F.col("low")).alias("best"), F.when(up, F.col("low")).when(~up, F.col("high")).alias("worst"))


def catalogue(spark) -> DataFrame:
    """The metric catalogue as a table."""
    rows = [(m.key, m.name, m.type, m.fixed, m.higher_is_better, m.display_in_summary, m.display_in_example) for m in METRICS]
    return spark.createDataFrame(rows, "key string, name string, type string, fixed int, higher_is_better boolean, display_in_summary boolean, display_in_example boolean")
