"""Curriculum and learning-rate schedules as functions of a step column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def competency(step: Column, initial: float = 0.01, total: int = 20000) -> Column:
    """The share of the data, easiest first, that is in use at a step."""
    return F.least(F.lit(1.0), F.sqrt((1 - initial**2) * step / total + initial**2))


def prefix_size(step: Column, rows: Column, initial: float = 0.01, total: int = 20000) -> Column:
    return F.floor(competency(step, initial, total) * rows).cast("long")


def _warm(step: Column, warmup: int, after: Column) -> Column:
    return F.when(step < warmup, step / max(1, warmup)).otherwise(after)


def static(step: Column, warmup: int = 0) -> Column:
    return _warm(step, warmup, F.lit(1.0))


def inverse_root(step: Column, warmup: int) -> Column:
    return F.least(F.lit(1.0), step / warmup) / F.sqrt(F.greatest(step, F.lit(warmup)))


def exponential(step: Column, warmup: int, scale: float, per_steps: int) -> Column:
    return _warm(step, warmup, F.pow(F.lit(scale), F.floor((step - warmup) / per_steps)))


def cosine(step: Column, warmup: int, reset: int = 200000, least: float = 0.0) -> Column:
    """With hard resets; ``least`` is the smallest multiplier."""
    progress = (step - warmup) / max(1, reset - warmup)
    return _warm(step, warmup, least + (1 - least) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (progress - F.floor(progress)))))
