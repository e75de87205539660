"""Approximate nearest neighbours by inner product: one navigable small-world graph a shard.

Rows are dealt to shards by a hash of their number, so a shard's rows are bounded whatever the input. Equal vectors of a shard are
one node with the list of its ids. A shard's index is flat arrays (vectors, neighbours of each layer, entry point) and is
written to the shared folder as one row; it is built once, and queries stream past it. Largest inner product becomes nearest
by angle through one more coordinate, ``sqrt(M^2 - |x|^2)`` with M the shard's longest vector. Each shard answers each query; the
answers of all shards are merged, ordered by the exact inner product in double precision, ties to the smaller id.

Defined results: vectors that are null, empty, all zero, or hold a null or non-finite component take no part, nor do rows with a
null id; rows with equal ids are rows of their own, and candidates of each other; vectors of another length are a world of their
own (nothing is near across lengths); with fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import dealt, pinned


@dataclass
class Graph:
    """Layer 0 has ``2 * m`` places a node, the layers above ``m``; unused places hold -1."""

    points: np.ndarray  # float32 [n, d + 1]
    level: np.ndarray  # int8 [n]
    base: np.ndarray  # int32 [n, 2 m]
    upper: dict[int, np.ndarray]  # layer -> int32 [n, m] (rows of nodes below the layer are unused)
    entry: int

    def neighbours(self, node: int, layer: int) -> np.ndarray:
        row = self.base[node] if layer == 0 else self.upper[layer][node]
        return row[row >= 0]


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors whose inner products order like those of ``x`` for any query with a last coordinate of 0."""
    rest = np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))
    return np.ascontiguousarray(np.column_stack((x, rest)) / longest, np.float32)


def search_layer(g: Graph, q: np.ndarray, starts: list[tuple[float, int]], ef: int, layer: int, seen: np.ndarray, mark: int) -> list[tuple[float, int]]:
    """The ``ef`` nearest nodes found from ``starts``, as (similarity, node), unordered. ``seen`` holds marks of nodes visited."""
    points = g.points
    best = list(starts)
    heapq.heapify(best)
    todo = [(-s, n) for s, n in starts]
    heapq.heapify(todo)
    for _, n in starts:
        seen[n] = mark
    table = g.base if layer == 0 else g.upper[layer]
    while todo:
        s, node = heapq.heappop(todo)
        if -s < best[0][0] and len(best) >= ef:
            break
        near = table[node]
        near = near[near >= 0]
        near = near[seen[near] != mark]
        if not len(near):
            continue
        seen[near] = mark
        sims = points[near] @ q
        worst = best[0][0]
        if len(best) >= ef:
            keep = sims > worst
            near, sims = near[keep], sims[keep]
        for x, n in zip(sims.tolist(), near.tolist(), strict=True):
            if len(best) < ef:
                heapq.heappush(best, (x, n))
                heapq.heappush(todo, (-x, n))
            elif x > best[0][0]:
                heapq.heapreplace(best, (x, n))
                heapq.heappush(todo, (-x, n))
    return best


def chosen(points: np.ndarray, found: tuple[np.ndarray, np.ndarray], m: int) -> np.ndarray:
    """Up to ``m`` of ``found`` (similarities, nodes): each nearer to the new node than to any taken before it, then the
    nearest of the rest."""
    sims, nodes = found
    order = np.lexsort((nodes, -sims))
    sims, nodes = sims[order], nodes[order]
    if len(nodes) <= m:
        return nodes
    among = points[nodes] @ points[nodes].T
    shut = np.zeros(len(nodes), bool)  # nearer to one that is taken than to the new node
    taken: list[int] = []
    for k in range(len(nodes)):
        if not shut[k]:
            taken.append(k)
            if len(taken) == m:
                break
            shut |= among[k] >= sims
    if len(taken) < m:
        rest = np.ones(len(nodes), bool)
        rest[taken] = False
        taken += np.flatnonzero(rest)[: m - len(taken)].tolist()
    return nodes[taken]


def build(points: np.ndarray, *, m: int = 16, ef: int = 64, seed: int = 5, block: int = 512) -> Graph:
    """Inserts the points one by one. A point's candidates on a layer are the ``ef`` nearest of those inserted before it, found
    exactly by products of blocks of points: for a shard's bounded size that is far cheaper than to search the graph for them.

    A full row of neighbours gets as many places again before it is chosen anew, so that is seldom done.
    """
    n = len(points)
    rng = np.random.default_rng(seed)
    level = np.minimum(-np.log(rng.random(n)) / math.log(m), 12).astype(np.int8) if n else np.zeros(0, np.int8)
    top = int(level.max(initial=0))
    layers: list[np.ndarray] = []
    for layer in range(top + 1):
        nodes = np.flatnonzero(level >= layer)
        width = 2 * m if layer == 0 else m
        wide = np.full((n, 2 * width), -1, np.int32)
        used = np.zeros(n, np.int32)
        mine = np.ascontiguousarray(points[nodes])

        def narrowed(other: int) -> None:
            row = wide[other, : used[other]]
            pick = chosen(points, (points[row] @ points[other], row), width)
            wide[other] = -1
            wide[other, : len(pick)] = pick
            used[other] = len(pick)

        for start in range(0, len(nodes), block):
            stop = min(start + block, len(nodes))
            sims = mine[start:stop] @ mine[:stop].T
            sims[:, start:][np.triu_indices(stop - start)] = -np.inf
            if stop > ef:
                near = np.argpartition(sims, stop - ef, 1)[:, stop - ef :]
                sims = np.take_along_axis(sims, near, 1)
            else:
                near = np.broadcast_to(np.arange(stop), sims.shape)
            for k in range(max(1 - start, 0), stop - start):
                node, real = nodes[start + k], sims[k] > -np.inf
                pick = chosen(points, (sims[k][real], nodes[near[k][real]]), m)
                wide[node, : len(pick)] = pick
                used[node] = len(pick)
                for other in pick:
                    wide[other, used[other]] = node
                    used[other] += 1
                    if used[other] == 2 * width:
                        narrowed(other)
        for other in np.flatnonzero(used > width):
            narrowed(other)
        layers.append(wide[:, :width].copy())
    entry = int(np.argmax(level)) if n else 0
    return Graph(points, level, layers[0], dict(enumerate(layers[1:], 1)), entry)


def nearest(g: Graph, q: np.ndarray, ef: int, seen: np.ndarray, mark: int) -> tuple[list[int], int]:
    """Nodes near ``q`` (``ef`` at most) and the next free mark."""
    if not len(g.points):
        return [], mark
    at = [(float(g.points[g.entry] @ q), g.entry)]
    for layer in range(int(g.level[g.entry]), 0, -1):
        mark += 1
        at = [max(search_layer(g, q, at, 1, layer, seen, mark))]
    mark += 1
    return [n for _, n in search_layer(g, q, at, ef, 0, seen, mark)], mark + 1


INDEX = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), *[(c, pa.binary()) for c in ("vectors", "ids", "rows", "id_stops", "level", "base", "upper")], ("entry", pa.int32()), ("m", pa.int32()), ("longest", pa.float64())])
INDEX_DDL = "dim int, shard int, vectors binary, ids binary, rows binary, id_stops binary, level binary, base binary, upper binary, entry int, m int, longest double"


def index_row(dim: int, shard: int, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, m: int, ef: int) -> pa.RecordBatch:
    """The flat arrays of one shard: distinct vectors in order, and for each the rows that have it, by ascending ids."""
    order = np.lexsort((rows, ids, *vectors.T[::-1]))
    ids, rows, vectors = ids[order], rows[order], vectors[order]
    new = np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(1)))
    distinct = vectors[new]
    stops = np.append(np.flatnonzero(new)[1:], len(ids)).astype(np.int64)
    # A random order of insertion: sorted vectors would grow a lopsided graph.
    shuffled = np.random.default_rng(shard).permutation(len(distinct))
    starts = np.concatenate(([0], stops[:-1]))
    ids, rows = (np.concatenate([x[starts[k] : stops[k]] for k in shuffled]) for x in (ids, rows))
    stops = np.cumsum((stops - starts)[shuffled])
    distinct = distinct[shuffled]
    longest = float(np.sqrt((distinct.astype(np.float64) ** 2).sum(1)).max())
    g = build(lifted(distinct.astype(np.float64), longest), m=m, ef=ef)
    upper = b"".join(g.upper[k].tobytes() for k in sorted(g.upper))
    cells = [dim, shard, distinct.tobytes(), ids.tobytes(), rows.tobytes(), stops.tobytes(), g.level.tobytes(), g.base.tobytes(), upper, g.entry, m, longest]
    return pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(cells, INDEX, strict=True)], schema=INDEX)


def opened(row: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Graph, original vectors, ids, rows, stops of ids."""
    n, m = len(row["level"]), row["m"]
    kind = np.float32 if len(row["vectors"]) == 4 * n * row["dim"] else np.float64
    vectors = np.frombuffer(row["vectors"], kind).reshape(n, row["dim"])
    upper = np.frombuffer(row["upper"], np.int32).reshape(-1, n, m)
    g = Graph(lifted(vectors.astype(np.float64), row["longest"]), np.frombuffer(row["level"], np.int8), np.frombuffer(row["base"], np.int32).reshape(n, 2 * m), {k + 1: u for k, u in enumerate(upper)}, row["entry"])
    return g, vectors, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64), np.frombuffer(row["id_stops"], np.int64)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v, dim``: the rows that take part, their vectors as they are (of float, or of double for any other numbers)."""
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    v = F.col(vector_col) if kind in ("float", "double") else F.col(vector_col).cast("array<double>")
    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return picked.where(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` written, with a number for each (``row``): a row's own, whatever its id."""
    return pinned(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def build_index(rows: DataFrame, *, shard_rows: int = 8192, least_shards: int = 6, m: int = 24, ef: int = 96) -> DataFrame:
    """One row of flat arrays a shard, written to the shared folder."""
    count = rows.count()
    shards = max(1, math.ceil(count / shard_rows), min(least_shards, math.ceil(count / 500)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task holds one shard of one length at a time: rows come sorted by both."""
        held: list[pa.RecordBatch] = []
        now: tuple | None = None

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            x = t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, now[0])
            return index_row(*now, t.column("vec_id").to_numpy(), t.column("row").to_numpy(), x, m, ef)

        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            at = 0
            while at < len(keys):
                stop = at
                while stop < len(keys) and keys[stop] == keys[at]:
                    stop += 1
                if now is not None and keys[at] != now:
                    yield done()
                    held = []
                now = keys[at]
                held.append(b.slice(at, stop - at))
                at = stop
        if held:
            yield done()

    keyed = rows.select("dim", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "row", "v")
    return pinned(dealt(keyed, shards, F.col("shard")).sortWithinPartitions("dim", "shard").mapInArrow(run, INDEX_DDL), "hnsw")


def inner(rows: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    return np.cumsum(rows.astype(np.float64) * v.astype(np.float64), 1)[:, -1]


FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])


class Shard:
    """An opened shard that answers queries one after another."""

    def __init__(self, row: dict):
        self.key = row["dim"], row["cell"]
        self.graph, self.vectors, self.ids, self.rows, self.stops = opened(row)
        self.starts = np.concatenate(([0], self.stops[:-1]))
        self.seen, self.mark = np.full(len(self.graph.points), -1, np.int64), 0

    def ask(self, query: int, v: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, rows and scores of the ``k`` nearest but the row ``query`` itself."""
        nodes, self.mark = nearest(self.graph, np.append(v, 0).astype(np.float32), max(ef, k + 1), self.seen, self.mark)
        # of equal vectors only the k + 1 smallest ids can be among the k nearest (one may be the query itself)
        mine = [np.arange(self.starts[n], min(self.stops[n], self.starts[n] + k + 1)) for n in nodes]
        score, each = np.repeat(inner(self.vectors[nodes], v), [len(i) for i in mine]), np.concatenate(mine)
        keep = self.rows[each] != query
        each, score = each[keep], score[keep]
        best = np.lexsort((self.rows[each], self.ids[each], -score))[:k]
        return self.ids[each[best]], self.rows[each[best]], score[best]


def search(index: DataFrame, queries: DataFrame, k: int, *, ef: int = 100, block: int = 1 << 18) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each query (``vec_id, row, v, dim``) but the query's own row.

    A cell is a shard and a block of queries. Its index comes first and its queries stream past it, so a task holds one graph
    and one batch however many queries there are. A block is far larger than an index: few indexes are sent twice.
    """
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = max(1, math.ceil(queries.count() / block))
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    graphs = index.withColumn("block", everywhere(blocks)).withColumn("cell", F.col("shard") * blocks + F.col("block")).drop("block", "shard")
    asked = queries.select("dim", "vec_id", "row", "v", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), everywhere(shards).alias("shard"))
    asked = asked.withColumn("cell", F.col("shard") * blocks + F.col("block")).drop("block", "shard")
    cells = graphs.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard | None = None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                held: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
                for i, (dim, cell, kind, ident, query) in enumerate(zip(*(b.column(c).to_pylist() for c in ("dim", "cell", "kind", "vec_id", "row")), strict=True)):
                    if kind == 0:
                        shard = None  # the one before may go first
                        shard = Shard(b.slice(i, 1).to_pylist()[0])
                    elif shard is not None and shard.key == (dim, cell):
                        held.append((query, ident, *shard.ask(query, b.column("v")[i].values.to_numpy(), k, ef)))
                if held:
                    each = [len(h[2]) for h in held]
                    arrays = (*(np.repeat(np.array([h[c] for h in held], np.int64), each) for c in (0, 1)), *(np.concatenate([h[c] for h in held]) for c in (2, 3, 4)))
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(arrays, FOUND, strict=True)], schema=FOUND)

    in_order = dealt(cells, shards * blocks, F.col("cell")).sortWithinPartitions("dim", "cell", "kind")
    found = in_order.mapInArrow(run, "query_row long, query_id long, vec_id long, row long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def self_search(vectors: DataFrame, asks: Column, k: int, **options) -> DataFrame:
    """Indexes all usable rows and asks for the ``k`` nearest of those for which ``asks`` holds."""
    rows = numbered(usable(vectors))
    return search(build_index(rows, **options), rows.where(asks), k)
