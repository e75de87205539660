"""What the operators of this package share: table access, the shared folder, and Arrow helpers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.sources.workspace import pinned, scratch, spare

__all__ = ["KeyFilter", "dealt", "fresh_path", "joined_to_groups", "partition_keys", "pinned", "shuffle_width", "spare", "table", "text_key"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's own readers, so any store that Spark can open will do."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return scratch(spark, name)


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text (null counts as empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partition_keys(spark: SparkSession, width: int) -> list[int]:
    """For each of ``width`` partitions a number that ``repartition(width, number)`` deals to it.

    Small numbers dealt by hash collide, and a few partitions get several groups; these keys give each group its own.
    """
    wanted = spark.range(width * (width.bit_length() + 8) * 2).groupBy(F.pmod(F.hash("id"), F.lit(width)).alias("p")).agg(F.min("id").alias("id"))
    found = {r.p: r.id for r in wanted.collect()}  # a row a partition
    return [found.get(p, p) for p in range(width)]


def dealt(df: DataFrame, width: int, group: Column) -> DataFrame:
    """Group k of ``width`` groups in partition k (beyond a few thousand groups by hash, some to one partition)."""
    if width > 4096:
        return df.repartition(width, group)
    keys = F.array(*[F.lit(k).cast("long") for k in partition_keys(df.sparkSession, width)])
    return df.withColumn("_slot", F.element_at(keys, group.cast("int") + 1)).repartition(width, "_slot").drop("_slot")


#: Bits of a key filter: 32 a key, and never more than 32 MB in all, so its broadcast has the same bound for any input.
BITS_A_KEY, LEAST_BITS, MOST_BITS, PAGE_BITS = 32, 1 << 15, 1 << 28, 1 << 15


@dataclass(frozen=True)
class KeyFilter:
    """Which rows may have one of a set of keys, by a bitmap that is broadcast: no key is missed, some others pass.

    It keeps texts from being shuffled for the sake of the few that are asked for. Whoever needs just the keys joins what
    passes. With far more keys than bits everything passes and that join is an ordinary one.
    """

    pages: DataFrame
    bits: int

    @staticmethod
    def of(keys: DataFrame, *key: str) -> KeyFilter:
        """From a written table of keys (it is counted first)."""
        bits, wanted = LEAST_BITS, keys.count() * BITS_A_KEY
        while bits < MOST_BITS and bits < wanted:
            bits *= 2
        at = F.pmod(F.xxhash64(F.lit(41), *key), F.lit(bits))
        placed = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / PAGE_BITS).alias("page")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(PAGE_BITS))).alias("bitmap"))
        return KeyFilter(placed, bits)

    def mark(self, rows: DataFrame, name: str, *key: str) -> DataFrame:
        """``rows`` with a boolean column: whether a row's key may be among the keys."""
        page, bitmap, at = spare(rows, "page", "bitmap", "at")
        pages = F.broadcast(self.pages.select(F.col("page").alias(page), F.col("bitmap").alias(bitmap)))  # MOST_BITS / 8 bytes at most
        placed = rows.withColumn(at, F.pmod(F.xxhash64(F.lit(41), *key), F.lit(self.bits)))
        found = placed.join(pages, F.floor(F.col(at) / PAGE_BITS) == F.col(page), "left")
        inside = F.pmod(F.col(at), F.lit(PAGE_BITS)).cast("int")
        byte = F.conv(F.hex(F.substr(bitmap, F.floor(inside / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return found.withColumn(name, F.coalesce(F.getbit(byte, F.pmod(inside, F.lit(8))) == 1, F.lit(False))).select(*rows.columns, name)

    def passing(self, rows: DataFrame, *key: str) -> DataFrame:
        (hit,) = spare(rows, "hit")
        return self.mark(rows, hit, *key).where(hit).drop(hit)


#: A group is hot with more than this share of all rows, so there are never more hot groups than its reciprocal.
HOT_SHARE = 0.001


def joined_to_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined to the row of their group (unique by ``key``, ``size`` rows each).

    Rows of hot groups meet theirs where they are, by a broadcast of at most 1 / HOT_SHARE rows; no task gets more than
    HOT_SHARE of all rows for one key.
    """
    hot = F.col(size) > F.lit(total * HOT_SHARE)
    (name,) = spare(rows, "hot")
    frequent = groups.where(hot)
    marked = rows.join(F.broadcast(frequent.select(key, F.lit(True).alias(name))), key, "left")
    common = marked.where(F.col(name)).drop(name).join(F.broadcast(frequent), key)
    return common.unionByName(marked.where(F.col(name).isNull()).drop(name).join(groups.where(~hot), key))
