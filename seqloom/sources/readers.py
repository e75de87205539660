"""Readers of the corpus formats. All lines carry a dense position where order matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import text
from seqloom.sources.workspace import spare

MATCHED = "decompiled_tokens array<string>, original_tokens array<string>, variable_names map<string,array<string>>, binary_hash string"


def matched_functions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of matched functions, one file a repository (``.../{owner}/{name}/matched_funcs.jsonl``).

    ``decompiled_code, original_code, var_names, repo, sha``; tokens are joined by NUL. Malformed lines come with a null code
    and the raw line in ``_corrupt_record``.
    """
    raw = spark.read.schema(MATCHED + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    repo = F.concat_ws("/", F.element_at(parts, -3), F.element_at(parts, -2))
    names = F.transform_values("variable_names", lambda _, v: F.struct(F.get(v, F.lit(0)).alias("decomp"), F.get(v, F.lit(1)).alias("orig")))
    return raw.select(
        text.join_tokens(F.col("decompiled_tokens")).alias("decompiled_code"), text.join_tokens(F.col("original_tokens")).alias("original_code"),
        names.alias("var_names"), repo.alias("repo"), F.col("binary_hash").alias("sha"), "_corrupt_record",
    )


def well_formed(df: DataFrame) -> DataFrame:
    return df.where("_corrupt_record IS NULL").drop("_corrupt_record")


def registry(df: DataFrame, max_repos: int | None = None) -> DataFrame:
    """Repositories with matched functions, in order of owner and name."""
    found = df.where("funcs_matched > 0")
    return found.orderBy("repo_owner", "repo_name").limit(max_repos) if max_repos is not None else found


def lines(spark: SparkSession, path: str, *, skip_empty: bool = True, strip: bool = True) -> DataFrame:
    """``idx, value`` in the order of files and lines, numbered densely (after empty lines are dropped, if they are).

    Lines are numbered within each split of a file and shifted by the splits before; the window over splits has a row a split.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    if strip:
        raw = raw.withColumn("value", text.strip(F.col("value")))
    if skip_empty:
        raw = raw.where("value <> ''")
    sizes = raw.groupBy("_f", "_b").agg(F.count("*").alias("_n"))
    shift = sizes.select("_f", "_b", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_f", "_b")) - F.col("_n")).alias("_s"))
    inside = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_m")) - 1
    return raw.withColumn("_i", inside).join(shift, ["_f", "_b"]).select((F.col("_i") + F.col("_s")).alias("idx"), "value")


def encoded(spark: SparkSession, path: str) -> DataFrame:
    """Encoded records as columns, with ``idx``."""
    return lines(spark, path).select("idx", text.decode_record(F.col("value")).alias("r")).select("idx", "r.*")


def pairs(spark: SparkSession, path: str, *, decode: bool = False, additional: bool = False, separator: str = text.TUPLE, token_separator: str = text.TOKEN) -> DataFrame:
    """``idx, src, tgt`` with tokens joined by spaces, subwords decoded on request, other fields on request."""
    p = F.split("value", separator, -1)
    fields = lines(spark, path).select("idx", F.get(p, F.lit(0)).alias("src"), F.array_join(F.slice(p, F.lit(2), F.greatest(F.size(p) - 5, F.lit(1))), separator).alias("tgt"), p.alias("p"))
    spell = lambda c: F.array_join(text.decode_pieces(F.split(c, token_separator, -1)) if decode else F.split(c, token_separator, -1), " ")
    out = fields.select("idx", spell("src").alias("src"), spell("tgt").alias("tgt"), "p")
    if additional:
        out = out.withColumns({n: F.element_at("p", i) for n, i in (("var_names", -4), ("score", -3), ("repo", -2), ("sha", -1))})
    return out.drop("p")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``id, token``: the first field of each line that isn't blank."""
    return lines(spark, path).select(F.col("idx").cast("int").alias("id"), F.get(text.words(F.col("value")), F.lit(0)).alias("token"))


def numbers(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select("idx", F.col("value").cast("double").alias("value"))


def binary_list(spark: SparkSession, path: str) -> DataFrame:
    """``repo, sha`` from the fields of each line."""
    w = text.words(F.col("value"))
    return lines(spark, path).select("idx", F.get(w, F.lit(0)).alias("repo"), F.get(w, F.lit(1)).alias("sha"))


def canonical(df: DataFrame) -> DataFrame:
    """Canonical rows with their token separators as in the other tables."""
    return df.withColumns({c: F.replace(c, F.lit(text.TUPLE), F.lit(text.TOKEN)) for c in ("src", "tgt", "raw_tgt")})


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Raw example blocks (parquet), with the file's name for order."""
    return spark.read.parquet(path).withColumn("block", F.element_at(F.split("_metadata.file_path", "/"), -1))


def report(spark: SparkSession, path: str) -> DataFrame:
    """A report document, compressed or not (by its name)."""
    return spark.read.option("multiLine", True).json(path)


#: How the first and the last line of a report begin: what is between them is one example a line.
OPENING, CLOSING = '{"metrics":', "]}"


def report_head(spark: SparkSession, path: str) -> DataFrame:
    """One row, ``metrics, systems``, of a report that ``write_report`` has written."""
    first = spark.read.text(path).where(F.col("value").startswith(OPENING)).first().value + CLOSING
    return spark.range(1).select(F.from_json(F.lit(first), F.schema_of_json(F.lit(first))).alias("d")).select("d.metrics", "d.systems")


def report_examples(spark: SparkSession, path: str, schema) -> DataFrame:
    """The examples of a report, streamed by member: a task for each, a line at a time. A line that isn't an example of ``schema`` is an error."""
    lines = spark.read.text(path).where(~F.col("value").startswith(OPENING) & (F.col("value") != CLOSING))
    return lines.select(F.from_json(F.rtrim(F.col("value"), F.lit(",")), schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def zipped(left: DataFrame, *others: DataFrame, on: str = "idx") -> DataFrame:
    """Lists of equal length side by side by position; lists of other lengths are an error when the result is read."""
    out = left
    for other in others:
        (mine,), (its,) = spare(out.join(other, on), "left"), spare(out.join(other, on), "right")
        missing = F.when(F.col(mine).isNull() | F.col(its).isNull(), F.raise_error(F.lit("lists of different lengths")).cast("boolean")).otherwise(True)
        out = out.withColumn(mine, F.lit(1)).join(other.withColumn(its, F.lit(1)), on, "full").where(missing).drop(mine, its)
    return out
