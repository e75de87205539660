"""The evaluation report: one JSON document, and a Markdown table of its summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import clang, formatting
from seqloom.operators.evaluation import METRICS
from seqloom.sources.workspace import spare


def signature_section(pretty: Column, sig: Column) -> Column:
    return F.struct(
        pretty.alias("code"), sig["name"].alias("func_name"), F.array_join(sig["ret_type"]["type"], " ").alias("ret_type"),
        F.transform(sig["args"], lambda a: F.struct(F.array_join(a["type"], " ").alias("type"), a["name"].alias("name"))).alias("args"),
    )


def example_rows(measured: DataFrame, baseline: str) -> DataFrame:
    """One row an example: target section, and a map from system to its prediction with matches and metrics.

    Expects ``idx, system, src, tgt, hyp, var_names, repo, sha`` beside the metric columns. The baseline shows its raw source.
    """
    shown, is_base = clang.shown_column(), F.col("system") == baseline
    found, pretty = spare(measured, "signature", "pretty")
    told = shown(F.col("hyp"), F.when(is_base, F.col("src")).otherwise(F.col("hyp")), is_base)
    rows = measured.withColumn(pretty, told).withColumn(found, F.col(pretty)["signature"]).withColumn(pretty, F.col(pretty)["code"])
    args = F.transform(
        F.arrays_zip(F.col(found)["args"].alias("args"), "match_idx", "arg_names", "arg_types"),
        lambda x: F.struct(F.array_join(x["args"]["type"], " ").alias("type"), x["args"]["name"].alias("name"), x["match_idx"].alias("match_idx"), x["arg_names"].alias("name_score"), x["arg_types"].alias("type_score")),
    )
    metrics = F.struct(*[F.col(m.key) if m.key in measured.columns else F.lit(0.0).alias(m.key) for m in METRICS])
    prediction = F.struct(
        F.col(pretty).alias("code"), F.col(found)["name"].alias("func_name"), F.array_join(F.col(found)["ret_type"]["type"], " ").alias("ret_type"), args.alias("args"), "missing_args", "missing_strings", "redundant_strings", metrics.alias("metrics"),
    )
    grouped = rows.select("idx", "tgt", "repo", "sha", "var_names", F.struct("system", prediction.alias("p")).alias("e")).groupBy("idx").agg(
        F.first("tgt").alias("tgt"), F.first("repo").alias("repo"), F.first("sha").alias("sha"), F.first("var_names").alias("var_map"), F.map_from_entries(F.sort_array(F.collect_list("e"))).alias("predictions")
    )
    target = grouped.withColumn("_shown", shown(F.col("tgt"), F.col("tgt"), F.lit(True)))
    return target.select(F.col("idx").alias("index"), F.struct("repo", "sha").alias("meta_data"), "var_map", signature_section(F.col("_shown.code"), F.col("_shown.signature")).alias("target"), "predictions")


def document(examples: DataFrame, systems: DataFrame) -> DataFrame:
    """Lines of one JSON document in order (``ordinal, line``): opening, one line an example, closing.

    Examples stay distributed: only metrics and systems, a few rows, are gathered.
    """
    spark = examples.sparkSession
    metrics = F.to_json(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in vars(m).items()]) for m in METRICS]))
    gathered = systems.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*systems.columns)))).alias("s"))
    opening = gathered.select(F.lit(-1).cast("long").alias("ordinal"), F.concat(F.lit('{"metrics":'), metrics, F.lit(',"systems":'), F.col("s"), F.lit(',"examples":[')).alias("line"))
    last = examples.agg(F.max("index")).scalar()
    lines = examples.select(F.col("index").cast("long").alias("ordinal"), F.concat(F.to_json(F.struct(*examples.columns)), F.when(F.col("index") < last, ",").otherwise("")).alias("line"))
    closing = spark.range(1).select(F.lit(2**62).cast("long").alias("ordinal"), F.lit("]}").alias("line"))
    return opening.unionByName(lines).unionByName(closing)


def summary_table(summary_rows: list[dict], show_colours: bool = False) -> str:
    """Metrics by systems, from a few collected rows of ``summarise``."""
    shown = [m for m in METRICS if m.display_in_summary]
    table = [["Metric", *(r["system"] for r in summary_rows)]]
    for m in shown:
        table.append([m.name, *(formatting.metric_value(m.type, r[m.key], m.fixed) for r in summary_rows)])
    colour = {True: "green", False: "red"}
    marks = {(i + 1, 0): colour[m.higher_is_better] for i, m in enumerate(shown) if m.higher_is_better is not None}
    return formatting.markdown_table(table, ["left"] + ["right"] * len(summary_rows), marks if show_colours else None)
