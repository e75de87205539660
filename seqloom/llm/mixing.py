"""Sources mixed to target weights by a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by a hash of id and text: each block is a random part of its source, of about
``block_docs`` documents whatever the source's size, so a source with a third of all rows is just more blocks. A source's
target in words becomes an exact quota of blocks: whole passes over all its blocks, then blocks in order until the target is
met. ``plan`` counts to the word, the last document in part; ``mix`` takes that document whole or not at all, whichever is nearer. A tree over the output shards splits the quotas: at each node the left half's share of each source is
one multivariate-hypergeometric draw, so every shard is a simple random sample of the mix, and the leaves add up to the quotas.
Each shard then takes the next blocks of each source's permuted list, disjoint from all others, and is shuffled by hash locally.

Only the tree is computed on the driver, from one number a source; it has a number for each source and shard that the source
reaches, at most sources times shards and at most the blocks drawn. All else is DataFrame functions: sums by block before anything is shuffled by source, windows only inside a block.

Targets: sources by code point, null last, have the given weights in turn; together they get ``share`` of all words; none
gets more than ``most`` times its words, and what is over goes to the others by weight until none is above.

Defined results: null text has size 0, is never taken and belongs to its source; rows with a null id take part; rows repeated as a
whole are documents of their own; a mix of an empty table, or of one without words, is empty; extra columns are carried along,
whatever their names: a row travels as one struct.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import dealt, joined_to_groups, pinned, shuffle_width

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Sources (a short row each) that are sent to all rows; beyond that only hot ones are.
SENT_SOURCES = 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(seed: int, doc_id: Column, text: Column) -> Column:
    """60 bits of a digest of id and text, which any other engine can compute."""
    given = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(given), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds ``target`` to one row a source (``source_key, source, source_size``): water filling in closed form.

    With sources by ``cap / weight``, a source is full iff filling all to its own level takes no more than there is.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most)).withColumn("level", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    up_to_here = Window.partitionBy(F.lit(0)).orderBy("level", "rank").rowsBetween(Window.unboundedPreceding, 0)
    filled = (
        capped.withColumn("total", F.sum("source_size").over(everything) * float(share))
        .withColumn("need", F.sum("cap").over(up_to_here) + F.col("level") * (F.sum("weight").over(everything) - F.sum("weight").over(up_to_here)))
        .withColumn("full", F.col("need") <= F.col("total"))
    )
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.try_divide(rest, open_weight)))
    return filled.withColumn("target", target).select("source_key", "source", "source_size", "n_docs", "target")


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """``shards x sources`` block counts; columns add up to ``quotas``."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, np.array(quotas, np.int64))]
    while stack:
        first, count, q = stack.pop()
        if count == 1:
            out[first] = q
            continue
        half, total = count // 2, int(q.sum())
        left = rng.multivariate_hypergeometric(q, round(total * half / count), method="marginals") if total else q
        stack += ((first, half, left), (first + half, count - half, q - left))
    return out


def plan(docs: DataFrame, carry: list[str] | None = None, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int | None = None, block_docs: int = 512, seed: int = 17) -> DataFrame:
    """``row`` (a struct of the columns ``carry`` of ``docs``, all by default), ``size, source_size, target, taken, u`` and
    ``draws array<struct<copy,shard,words>>``: one row for each row of ``docs``."""
    spark = docs.sparkSession
    shards = shards or shuffle_width(spark)
    keyed = docs.select(
        F.struct(*(docs.columns if carry is None else carry)).alias("row"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), shuffle_key(seed, F.col("doc_id"), F.col("text")).alias("u"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source_key"),
    )
    narrow = pinned(keyed.select("source_key", "source", "size", "u"), "sizes")
    sources = narrow.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    goal = targets(sources, weights, share, most)
    quota = F.round("target").cast("long")
    goal = goal.withColumn("passes", F.coalesce(F.floor(F.try_divide(quota, F.col("source_size"))), F.lit(0)).cast("int")).withColumn("rest", F.when(F.col("source_size") > 0, quota - F.col("passes") * F.col("source_size")).otherwise(F.lit(0)))
    goal = pinned(goal.withColumn("n_blocks", F.ceil(F.col("n_docs") / block_docs)), "targets")
    n_sources, n_rows = goal.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0))).first()

    def of_source(rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` with columns of their source, without a task that gets a large source whole."""
        told = goal.select("source_key", "n_docs", *columns)
        joined = rows.join(F.broadcast(told), "source_key") if n_sources <= SENT_SOURCES else joined_to_groups(rows, told, "source_key", "n_docs", n_rows)
        return joined.drop("n_docs")

    # Blocks, where each starts in its source's permuted words, and how often each is drawn.
    block = F.pmod(F.col("u"), F.col("n_blocks")).alias("block")
    sums = of_source(narrow, "n_blocks", "passes", "rest").select("source_key", block, "size", "passes", "rest").groupBy("source_key", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    drawn = blocks.withColumn("copies", F.col("passes") + F.when(F.col("start") < F.col("rest"), 1).otherwise(0)).where("copies > 0 AND words > 0")
    instances = drawn.select("source_key", "block", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    order = Window.partitionBy("source_key").orderBy(F.xxhash64(F.lit(seed + 1), F.col("source_key"), F.col("block"), F.col("copy")), "block", "copy")
    permuted = pinned(instances.withColumn("at", F.row_number().over(order) - 1), "blocks")

    counts = permuted.groupBy("source_key").count().orderBy("source_key").collect()  # a row a source
    tree = splitting_tree([r["count"] for r in counts], shards, seed) if counts else np.zeros((shards, 0), np.int64)
    leaves = [{"k": r["source_key"], "s": (at := np.flatnonzero(tree[:, i])).tolist(), "c": tree[at, i].tolist()} for i, r in enumerate(counts)]
    cut = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(leaves)), "array<struct<k:string,s:array<int>,c:array<bigint>>>")))
    runs = cut.select("k", F.inline(F.arrays_zip("s", "c"))).withColumnsRenamed({"s": "shard", "c": "n"})
    runs = runs.withColumn("stop", F.sum("n").over(Window.partitionBy("k").orderBy("shard")))
    slots = runs.select(F.col("k").alias("source_key"), "shard", F.explode(F.sequence(F.col("stop") - F.col("n"), F.col("stop") - 1)).alias("at"))
    placed = permuted.join(slots, ["source_key", "at"]).groupBy("source_key", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("places"))  # at most ceil(most) copies a block
    by_block = blocks.join(placed, ["source_key", "block"], "left").join(goal.select("source_key", "source_size", "target"), "source_key")
    by_block = by_block.select("source_key", "block", "start", "places", "passes", "rest", "source_size", "target")

    numbered = of_source(keyed.drop("source"), "n_blocks").withColumn("block", F.pmod("u", "n_blocks")).drop("n_blocks")
    inside = Window.partitionBy("source_key", "block").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
    found = numbered.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(by_block, ["source_key", "block"])
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("before")))
    words = lambda p: F.when(p["copy"] <= F.col("passes"), F.col("size")).otherwise(extra)
    draws = F.filter(F.transform(F.coalesce("places", F.array()), lambda p: F.struct(p["copy"].alias("copy"), p["shard"].alias("shard"), words(p).alias("words"))), lambda d: d["words"] > 0)
    out = found.withColumn("draws", draws).withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]))
    return out.select("row", "size", "source_size", "target", "taken", "draws", "u")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, whole, once for each draw, by shard and in shuffled order within it.

    The last document of a source, of which the plan takes a part, is taken if that is half of it or more: a source's words are
    then off their target by half a document at most.
    """
    drawn = plan(docs, **options).select("row", "size", "u", F.explode("draws").alias("d")).where(2 * F.col("d.words") >= F.col("size"))
    width = options.get("shards") or shuffle_width(docs.sparkSession)
    local = dealt(drawn, width, F.col("d.shard")).sortWithinPartitions(F.col("d.shard"), F.xxhash64(F.col("d.shard"), F.col("u"), F.col("d.copy")))
    return local.select(*(F.col("row")[c].alias(c) for c in docs.columns))
