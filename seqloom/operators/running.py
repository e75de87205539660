"""Means and totals that run along a global order, or along the order of each group, without a window above a range.

Rows are dealt by range of group and order. A mean of the last rows needs those just before a range: each range passes its last
ones on to the ranges that start within reach. Totals need only a sum for each range and group before: a scan of range sums.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.corpus import ranged
from seqloom.sources.workspace import spare


def running_mean(df: DataFrame, value: str, order: str, rows: int, by: str | None = None, width: int | None = None) -> DataFrame:
    """Adds ``running``: the mean of the last ``rows`` values in order, of the whole table or of each value of ``by``.

    Null values are rows without a value, and a mean of none is null; null orders come first, equal ones in some order.
    """
    part, place, at, start, stop, home = spare(df, "part", "place", "at", "start", "stop", "home")
    placed = ranged(df, [*([F.col(by)] if by else []), F.col(order)], part, place, width)
    sizes = placed.groupBy(part).agg(F.count("*").alias(at))
    ranges = sizes.select(part, F.sum(at).over(Window.partitionBy(F.lit(0)).orderBy(part)).alias(stop), at).select(part, (F.col(stop) - F.col(at)).alias(start), stop)  # a row a range
    starts = F.from_json(F.lit(json.dumps([{"part": r[part], "start": r[start]} for r in ranges.collect()])), "array<struct<part:int,start:bigint>>")
    numbered = placed.join(F.broadcast(ranges), part).withColumn(at, F.col(place) + F.col(start))
    needed = list(dict.fromkeys(c for c in (by, value) if c))
    # A row goes on to the later ranges that start less than ``rows`` behind it: mostly one, more where ranges are short.
    reached = F.filter(starts, lambda s: (s["start"] > F.col(at)) & (s["start"] < F.col(at) + rows))
    passed = numbered.where(F.col(at) > F.col(stop) - rows).select(F.explode(reached).alias(home), at, *needed).select(F.col(home)["part"].alias(part), at, *needed)
    both = numbered.withColumn(home, F.lit(True)).unionByName(passed.withColumn(home, F.lit(False)), allowMissingColumns=True)
    window = Window.partitionBy(part, *([by] if by else [])).orderBy(at).rowsBetween(1 - rows, 0)
    return both.withColumn("running", F.avg(value).over(window)).where(home).select(*df.columns, "running")


def running_totals(df: DataFrame, order: list[Column], values: dict[str, Column], by: str | None = None, width: int | None = None) -> DataFrame:
    """Adds the sums so far of ``values`` (by name), the row's own included, of the whole table or of each value of ``by``.

    A group with a third of all rows is spread over many ranges.
    """
    part, place, key, home = spare(df, "part", "place", "key", "home")
    inner = spare(df, *(f"{n}_value" for n in values))
    shift = spare(df, *(f"{n}_before" for n in values))
    group = F.col(by) if by else F.lit(0)
    carried = df.select("*", group.alias(key), *(v.alias(n) for n, v in zip(inner, values.values(), strict=True)))
    rows = ranged(carried, [F.col(key), *order], part, place, width)
    sums = rows.groupBy(part, key).agg(*(F.sum(n).alias(s) for n, s in zip(inner, shift, strict=True)))  # a row a range and group
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col(part).alias(home), F.col(key).alias(f"{key}2"), *(F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(s) for s in shift))
    joined = rows.join(before, (F.col(part) == F.col(home)) & F.col(key).eqNullSafe(F.col(f"{key}2")))
    here = Window.partitionBy(part, key).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*df.columns, *((F.coalesce(F.sum(n).over(here), F.lit(0)) + F.col(s)).alias(name) for name, n, s in zip(values, inner, shift, strict=True)))
