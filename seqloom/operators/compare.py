"""Comparing two systems example by example: filter on several metrics, sort by several, page through."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.corpus import dense_index
from seqloom.operators.evaluation import METRICS

KINDS = {m.key: m for m in METRICS}


def comparable(key: str, row: Column) -> Column:
    """A metric's value as compared: portions by their correct part alone, confusions by F1."""
    kind = KINDS[key].type if key in KINDS else "float"
    if kind == "portion":
        return row[key]["correct"].cast("double")
    if kind == "confusion_mat":
        c = row[key]
        return 2 * c["tp"] / F.greatest(F.lit(1), 2 * c["tp"] + c["fp"] + c["fn"])
    return row[key].cast("double")


def compare(key: str, left: Column, right: Column) -> Column:
    """Negative where ``left`` is better."""
    a, b = comparable(key, left), comparable(key, right)
    better = KINDS[key].higher_is_better if key in KINDS else True
    return b - a if better or better is None else a - b


def difference(key: str, left: Column, right: Column) -> Column:
    return comparable(key, right) - comparable(key, left)


def winners(key: str, left: Column, right: Column) -> Column:
    """``left``, ``right`` or (for a tie) ``both``."""
    c = compare(key, left, right)
    return F.when(c < 0, "left").when(c > 0, "right").otherwise("both")


def better_on_all(measured: DataFrame, index: str, a: str, b: str, keys: list[str]) -> DataFrame:
    """``index, left, right, cmp_*, ordinal``: examples where system a beats b on every selected metric, biggest wins first.

    Without selected metrics all examples in index order. ``ordinal`` is 0-based.
    """
    side = lambda name: measured.where(F.col("system") == name).select(index, F.struct(*[c for c in measured.columns if c != index]).alias(name_of[name]))
    name_of = {a: "left", b: "right"}
    if a == b:
        raise ValueError("two different systems are needed")
    both = side(a).join(side(b), index)
    both = both.withColumns({f"cmp_{k}": compare(k, F.col("left"), F.col("right")) for k in keys}) if keys else both
    if keys:
        # coalesced, or each side is searched for nulls first, for which metrics that Python makes would be made twice
        both = both.where(reduce(lambda x, y: x & y, [F.coalesce(F.col(f"cmp_{k}") < 0, F.lit(False)) for k in keys]))
    return dense_index(both, [*(F.col(f"cmp_{k}") for k in keys), F.col(index)], "ordinal")


def page(df: DataFrame, number: int, size: int = 10) -> DataFrame:
    return df.where((F.col("ordinal") >= number * size) & (F.col("ordinal") < (number + 1) * size)).withColumn("place", F.pmod("ordinal", F.lit(size)))


def shown_pages(current: int, pages: int, around: int = 4) -> list[int]:
    return list(range(max(0, current - around), min(pages, current + around + 1)))


def gather(df: DataFrame, key: str, wanted: list, ordinal: str = "ordinal") -> DataFrame:
    """Rows by key in the order asked for, repeated if asked for repeatedly."""
    asked = F.from_json(F.lit(json.dumps([str(w) for w in wanted])), "array<string>")
    keys = df.sparkSession.range(1).select(F.posexplode(asked).alias(ordinal, "_key"))
    return df.join(F.broadcast(keys), df[key].cast("string") == keys["_key"]).drop("_key")


def tag_index(systems: DataFrame, key: str = "key", tags: str = "tags") -> DataFrame:
    """``tag, systems``: the ordinals of the systems that carry each tag."""
    return systems.select(F.explode(tags).alias("tag"), "ordinal").groupBy("tag").agg(F.sort_array(F.collect_list("ordinal")).alias("systems"))


def with_any_tag(systems: DataFrame, wanted: list[str], tags: str = "tags") -> DataFrame:
    return systems.where(F.arrays_overlap(F.col(tags), F.array(*[F.lit(w) for w in wanted])))
