"""Where intermediate tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share. Only a session within one machine may do without: it gets a folder
    of its own. Anywhere else a machine's own folder would lose what other machines write, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="seqloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what is read twice is the same, and lost executors cost nothing done."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """``df`` dealt evenly over tasks of about so many rows, and over every core: for work that is dear by the row. Spark cuts files by their
    bytes, so a million short rows would be one task's."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


def spare(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, with as many underscores in front as keep them apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    under = "_"
    while any((under + n).lower() in taken for n in names):
        under += "_"
    return tuple(under + n for n in names)
