"""Streaming ingest with first-wins deduplication.

``deduplicated`` keeps its keys in the stream's own state, which without an event time grows without bound. ``ingest`` holds no state: the
keys of all batches lie in files beside the output, and each batch is joined against them. Batches' keys are merged in generations, as
digits carry: ``fan`` files of one level become one of the next, so a batch reads a few tables however many there were before it,
and each key is written again once a level. What a batch reads and writes depends on its number alone; a batch that is run again after
a failure overwrites what it left and changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.corpus import first_of_each
from seqloom.sources.workspace import spare


def file_stream(spark: SparkSession, path: str, schema, *, files_per_trigger: int = 8, format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(format).load(path)


def deduplicated(stream: DataFrame, keys: list[str], event_time: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """The first arrival of each key. With an event time the state is bounded by the watermark, else it grows with the keys."""
    if event_time:
        return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def drain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there now as parquet and ends; a second call goes on where the first stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def windowed_counts(stream: DataFrame, event_time: str, window: str, *by: str, lateness: str = "1 hour") -> DataFrame:
    return stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, window), *by).count()


def generations(batch: int, fan: int) -> list[tuple[int, int]]:
    """The tables that hold the keys of all batches before ``batch``, as (level, first batch): a level ``p`` table holds ``fan ** p`` of them."""
    out, first, level = [], 0, 0
    while fan ** (level + 1) <= batch:
        level += 1
    for p in range(level, -1, -1):
        while first + fan**p <= batch:
            out.append((p, first))
            first += fan**p
    return out


def merged_after(batch: int, fan: int) -> list[tuple[int, int]]:
    """The tables that are complete with ``batch`` and made of the ``fan`` ones below them, lowest level first."""
    out, p = [], 1
    while (batch + 1) % fan**p == 0:
        out.append((p, batch + 1 - fan**p))
        p += 1
    return out


class Keys:
    """The keys of earlier batches under ``path``."""

    def __init__(self, path: str, keys: list[str], fan: int):
        self.path, self.keys, self.fan = path, keys, fan

    def at(self, level: int, first: int) -> str:
        return f"{self.path}/level-{level}/from-{first}"

    def unknown(self, rows: DataFrame, batch: int) -> DataFrame:
        """The rows whose keys no batch before ``batch`` had."""
        for level, first in generations(batch, self.fan):
            known = rows.sparkSession.read.schema(rows.select(self.keys).schema).parquet(self.at(level, first))
            same = reduce(lambda x, y: x & y, (rows[k].eqNullSafe(known[k]) for k in self.keys))
            rows = rows.join(known, same, "left_anti")
        return rows

    def add(self, rows: DataFrame, batch: int) -> None:
        rows.select(self.keys).write.mode("overwrite").parquet(self.at(0, batch))
        for level, first in merged_after(batch, self.fan):
            below = [self.at(level - 1, first + k * self.fan ** (level - 1)) for k in range(self.fan)]
            rows.sparkSession.read.schema(rows.select(self.keys).schema).parquet(*below).write.mode("overwrite").parquet(self.at(level, first))

    def clear(self, spark: SparkSession, batch: int) -> None:
        """Removes what was merged before ``batch`` began: no batch will read it again."""
        for level, first in merged_after(batch - 1, self.fan) if batch else []:
            for k in range(self.fan):
                path = spark._jvm.org.apache.hadoop.fs.Path(self.at(level - 1, first + k * self.fan ** (level - 1)))
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ingest(stream: DataFrame, path: str, keys: list[str], *, order: str | None = None, fan: int = 8, trigger: dict | None = None) -> StreamingQuery:
    """Writes the first row of each key under ``path/rows`` (a folder a batch) and ends when all that is there now is written; a second
    call goes on where the first stopped. Of a batch's rows with one key the first by ``order`` counts (any, without). Null keys are a key.
    """
    known = Keys(f"{path}/keys", keys, fan)

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known.clear(spark, number)
        (whole,) = spare(batch, "key")
        keyed = batch.withColumn(whole, F.struct(*keys))
        first = first_of_each(keyed, whole, order or keys[0]).drop(whole)
        target = f"{path}/rows/batch={number}"
        known.unknown(first, number).write.mode("overwrite").parquet(target)
        known.add(spark.read.schema(batch.schema).parquet(target), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def ingested(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``ingest`` has written."""
    return spark.read.schema(schema).parquet(f"{path}/rows").drop("batch")
