"""Connected components of a graph given as edges, in linear space: alternating large and small stars.

Each round writes its edges to the shared folder, so lineage stays short and a lost executor costs one round. The number of
rounds grows with the logarithm of the nodes. No row count ever exceeds the edges of the round before plus the nodes.
The centre of a large star is a frequent key of the join that moves larger neighbours: its other side, one row a key, is dealt
anew after its aggregate, so both sides come straight from an exchange and adaptive execution may split the centre's rows over
tasks. Aggregates combine before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import pinned


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: each node that has an edge to another one, and the least node of its component (roots included).

    Edges with a null end and loops are ignored; repeated edges and either direction are fine; no edges, no rows.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = pinned(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition("u", "m")
        # Large star: larger neighbours move to the least one. Where a node is its own least, its edges stay as they are.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours, and the node itself, move to the least one.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = pinned(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
