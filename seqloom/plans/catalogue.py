"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqloom.plans import code_queries, corpus_queries, evaluation_queries, io_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**corpus_queries.Q, **evaluation_queries.Q, **io_queries.Q, **code_queries.Q}
ORACLE: dict[str, str] = {**corpus_queries.S, **evaluation_queries.S, **io_queries.S, **code_queries.S}
