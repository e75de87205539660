"""Table functions for SQL: ``SELECT ... FROM rows, LATERAL lex(rows.code)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from seqloom.functions import clang


class Lex:
    """A row for each C token: its place, its type and its value; none for null."""

    def eval(self, code: str) -> Iterator[tuple[int, str, str]]:
        for place, (kind, value) in enumerate(clang.lex(code or "")):
            yield place, kind, value


class LexBoth:
    """A row for each place at which two codes have a token: the place, the first one's type and value, and the other's. Each code is
    read once, where two calls of ``lex`` side by side would read the second one again for every token of the first."""

    def eval(self, code: str, other: str) -> Iterator[tuple[int, str, str, str, str]]:
        for place, (mine, its) in enumerate(zip(clang.lex(code or ""), clang.lex(other or ""), strict=False)):
            yield place, *mine, *its


class Arguments:
    """A row for each parameter of a C function: its place, name, type and pointer layers; none where the code can't be parsed."""

    def eval(self, code: str) -> Iterator[tuple[int, str, str, int]]:
        found, _ = clang.parsed(clang.head(code or ""), strict=False)
        for place, a in enumerate(found.args):
            yield place, a.name, " ".join(a.type), a.pointer_layer


FUNCTIONS = {
    "lex": (Lex, "place int, type string, value string"), "lex_both": (LexBoth, "place int, type string, value string, other_type string, other_value string"),
    "arguments": (Arguments, "place int, name string, type string, pointer_layer int"),
}


def register(spark: SparkSession) -> None:
    """Makes ``lex``, ``lex_both`` and ``arguments`` known to the session's SQL."""
    for name, (handler, returns) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, returnType=returns))
