"""Driver-side file chores: copying files by path templates, memoised tables, evaluation bundles."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession


def filled(template: str, **values: str) -> str:
    """A path template such as ``.../{repo}/bin/{sha}``."""
    return template.format(**values)


def copy_files(pairs: Iterable[tuple[str, str]], templates: Mapping[str, str], target: str) -> dict[str, int]:
    """Copies each (repo, sha)'s file of each kind to ``target/kind/sha`` and counts those that exist."""
    done = dict.fromkeys(templates, 0)
    for kind in templates:
        os.makedirs(os.path.join(target, kind), exist_ok=True)
    for repo, sha in pairs:
        for kind, template in templates.items():
            source = filled(template, repo=repo, sha=sha)
            if os.path.exists(source):
                shutil.copy(source, os.path.join(target, kind, sha + os.path.splitext(source)[1]))
                done[kind] += 1
    return done


def memoised(spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table at ``path``; built and written first if it is not there (or is to be made anew)."""
    if not refresh:
        try:
            return spark.read.parquet(path)
        except Exception as e:  # only a missing path means that the table has to be built
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_bundle(examples: DataFrame, hypotheses: DataFrame, path: str) -> None:
    """An evaluation bundle in long form: ``examples (idx, ...)`` and ``hypotheses (idx, system, hyp, overlap)``."""
    examples.write.parquet(f"{path}/examples")
    hypotheses.write.partitionBy("system").parquet(f"{path}/hypotheses")


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """One row an example and system; systems are joined by key."""
    return spark.read.parquet(f"{path}/hypotheses").join(spark.read.parquet(f"{path}/examples"), "idx")
