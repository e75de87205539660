"""Near-duplicate texts: pairs whose sets of word n-grams have a Jaccard similarity of at least a threshold.

Steps. (1) Equal texts collapse to one node with a count of copies, so copies never meet in pairs. (2) Each node gets a
MinHash signature; nodes with equal signatures share one place from here on. (3) Signatures are cut into bands; nodes that
agree on a band are candidates. Buckets with the same members are looked at once. (4) Inside a bucket, pairs are compared hash
by hash in steps of 32 and dropped as soon as the posterior probability that their similarity reaches the threshold falls
below ``tolerance`` (uniform prior); what remains links nodes to clusters. (5) Within each cluster every pair is verified
exactly on the n-gram sets, and the true links give classes and counts.

A bucket or cluster above ``LEAST_TILE`` nodes is cut into tiles and each pair of tiles is its own unit of work. Up to eight tiles
they spread a group over tasks; beyond, a tile has ``TILE`` nodes or ``TILE_BYTES`` of text, so no task ever holds more than two
such tiles (or two texts), however many nodes are alike. Pairs are never rows: a unit gives a row for each of its nodes. A
group of k tiles is copied k times; counting the links between n mutually similar different texts is quadratic in n in
arithmetic, which exact counts need.

Verification compares the words themselves: within a unit words are numbered by an exact dictionary and n-grams by those
numbers, so equal hashes of different n-grams change nothing. Hashes are used to find candidates only.

At the default 32 bands of 4, a pair at the threshold itself shares no band with probability 5e-8.

Words are lower-cased and cut at white space. A text of 1 to n-1 words is one n-gram of all its words. A text without words
(null counts as empty) has no n-grams and only its copies belong with it. Equal texts are linked. Rows with a null id take
part; ``class_id`` is the least id of the class that isn't null (null if there is none). Repeated rows are copies.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import KeyFilter, pinned, text_key
from seqloom.llm.components import components

BANDS, ROWS, STEP = 32, 4, 32
HASHES = BANDS * ROWS
TILE, LEAST_TILE, SPREAD, TILE_BYTES = 4096, 512, 8, 1 << 24
SLICE = 128
_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
WEIGHT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word n-grams of each text, one text after another and not yet distinct; and how many each has."""
    words = [t.lower().split() if t else [] for t in texts]
    count = np.array([len(w) for w in words], np.int64)
    if not count.sum():
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    coded = pa.array([w for ws in words for w in ws], pa.large_string()).dictionary_encode()
    of_word = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    h = of_word[coded.indices.to_numpy()]
    total = np.zeros(len(h), np.uint64)
    for i in range(min(n, len(h))):
        total[: len(h) - i] += h[i:] * WEIGHT[i]
    stop = np.cumsum(count)
    left = np.repeat(stop, count) - np.arange(len(h))  # words from here to the end of the text
    keep = left >= n
    first = np.zeros(len(h), bool)
    short = (count > 0) & (count < n)
    for k in np.flatnonzero(short):
        at = stop[k] - count[k]
        first[at] = True
        total[at] = (h[at : stop[k]] * WEIGHT[: count[k]]).sum() + np.uint64(count[k])
    return mixed(total[keep | first]), np.where(short, 1, np.maximum(count - n + 1, 0))


def signatures(flat: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``len(count) x HASHES`` MinHash values (32 bits); rows without n-grams hold the largest value."""
    out = np.full((len(count), HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(count)
    if len(full):
        start = (np.cumsum(count) - count)[full]
        for i in range(HASHES):
            out[full, i] = np.minimum.reduceat(((flat * MULTIPLY[i] + ADD[i]) >> np.uint64(32)).astype(np.uint32), start)
    return out


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For 32, 64, ... compared hashes, the fewest equal ones at which P(similarity >= threshold) is still ``tolerance``.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1); its upper tail is a binomial sum.
    """

    def tail(m: int, n: int) -> float:
        return sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return {n: next(m for m in range(n + 1) if tail(m, n) >= tolerance) for n in range(STEP, HASHES + 1, STEP)}


def survivors(one: np.ndarray, others: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Positions in ``others`` that are not pruned against ``one``, compared incrementally."""
    alive, matches = np.arange(len(others)), np.zeros(len(others), np.int64)
    for stop in range(STEP, HASHES + 1, STEP):
        matches = matches + (others[alive, stop - STEP : stop] == one[stop - STEP : stop]).sum(1)
        keep = matches >= least[stop]
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def clustered(sigs: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """For each row the first row of its cluster: the transitive closure of what pruning leaves."""
    label = np.full(len(sigs), -1)
    for first in range(len(sigs)):
        if label[first] >= 0:
            continue
        label[first] = first
        frontier = [first]
        open_ = np.flatnonzero(label < 0)
        while frontier and len(open_):
            near = open_[survivors(sigs[frontier.pop()], sigs[open_], least)]
            label[near] = first
            frontier += near.tolist()
            open_ = open_[label[open_] < 0]
    return label


def exact_grams(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text its distinct word n-grams as numbers: equal numbers, equal words, in all of ``texts``."""
    words = [t.lower().split() if t else [] for t in texts]
    count = np.array([len(w) for w in words], np.int64)
    if not count.sum():
        return [np.zeros(0, np.int64) for _ in texts]
    coded = pa.array([w for ws in words for w in ws], pa.large_string()).dictionary_encode()
    h, base = coded.indices.to_numpy().astype(np.int64) + 1, len(coded.dictionary) + 1
    stop = np.cumsum(count)
    left = np.repeat(stop, count) - np.arange(len(h))  # words from here to the end of the text
    at = np.flatnonzero((left >= n) | (left == np.repeat(count, count)))  # a short text has the n-gram of all its words, filled up with 0
    code, left = h[at], left[at]
    for i in range(1, n):
        following = np.where(left > i, h[np.minimum(at + i, len(h) - 1)], 0)
        code = np.unique(code * base + following, return_inverse=True)[1]
    each = np.where((count > 0) & (count < n), 1, np.maximum(count - n + 1, 0))
    return [np.unique(x) for x in np.split(code, np.cumsum(each)[:-1])]


def linked(sets: list[np.ndarray], threshold: tuple[int, int], rows: int = 1024, width: int = 1024) -> np.ndarray:
    """Boolean matrix of pairs of sets whose Jaccard similarity is at least p/q, exactly; counted by blocks of rows and values."""
    p, q = threshold
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    shared = np.bincount(column, minlength=len(values)) > 1
    slot = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], slot[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = int(shared.sum())
    cuts = np.searchsorted(column, np.arange(0, total + width, width))
    out = np.zeros((n, n), bool)
    for first in range(0, n, rows):
        mine = slice(first, min(first + rows, n))
        common = np.zeros((mine.stop - first, n), np.float32)  # counts stay far below 2 ** 24, so floats are exact
        for k, at in enumerate(range(0, total, width)):
            block = np.zeros((n, min(width, total - at)), np.float32)
            block[row[cuts[k] : cuts[k + 1]], column[cuts[k] : cuts[k + 1]] - at] = 1
            common += block[mine] @ block.T
        out[mine] = common.astype(np.int64) * (p + q) >= p * (size[mine, None] + size[None, :])
    return out & (size[:, None] > 0) & (size[None, :] > 0)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns, from rows that come sorted by them."""
    rows = (r for b in batches for at in range(0, b.num_rows, 1024) for r in zip(*(c.to_pylist() for c in b.slice(at, 1024).columns), strict=True))
    for key, run in groupby(rows, key=lambda r: r[:keys]):
        yield key, [r[keys:] for r in run]


def tiled(df: DataFrame, size: str, node: str, size_bytes: Column | int = 0) -> DataFrame:
    """Adds ``t, i, j``: a row's tile, and the pair of tiles it is needed for. A group of one tile is one unit."""
    least = F.least(F.lit(SPREAD), F.ceil(F.col(size) / LEAST_TILE))
    n = F.greatest(least, F.ceil(F.col(size) / TILE), F.ceil((F.lit(size_bytes) if isinstance(size_bytes, int) else size_bytes) / TILE_BYTES)).cast("int")
    mine = F.pmod(F.xxhash64(node), n).cast("int")
    return df.withColumn("t", mine).withColumn("u", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("i", F.least("t", "u")).withColumn("j", F.greatest("t", "u")).drop("u")


def near_duplicates(docs: DataFrame, *, n: int = 5, threshold: tuple[int, int] = (4, 5), tolerance: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, class_size, n_links, text_key, class_key``: one row for each row of ``docs``.

    ``threshold`` is a fraction p/q, so the exact test is on integers. ``n_links`` counts the other rows at or above it.
    ``class_key`` is the class itself: where ids are repeated or null, separate classes may have the same ``class_id``.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    least = least_matches(threshold[0] / threshold[1], tolerance)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                flat, count = grams(b.column(2).to_pylist(), n)
                sig = signatures(flat, count)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.tobytes() if c else None for s, c in zip(sig, count, strict=True)], pa.binary()), pc.binary_length(b.column(2)).cast(pa.int64())], names=["doc_id", "key", "sig", "bytes"])

    signed = base.select("doc_id", "key", "text").mapInArrow(sign, "doc_id long, key binary, sig binary, bytes long")
    nodes = pinned(signed.groupBy("key").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bytes").alias("bytes")), "nodes")

    # Candidates: places (distinct signatures) by band.
    places = nodes.where("sig IS NOT NULL").groupBy("sig").agg(F.min("key").alias("place"))
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (4 * ROWS) + 1, F.lit(4 * ROWS)))))
    slim = places.select("place", band.alias("h"))
    buckets = slim.groupBy("h").agg(
        F.count("*").alias("size"), F.sum(F.xxhash64("place").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), F.col("place"))).alias("x")
    ).where("size > 1")
    kept = buckets.groupBy("size", "s", "x").agg(F.min("h").alias("h")).select("h", "size")
    members = slim.join(kept, "h").join(places, "place")
    units = tiled(members, "size", "place").select("h", "i", "j", "place", "sig")
    keys = ["h", "i", "j"]

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, 3):
            rows.sort()
            label = clustered(np.frombuffer(b"".join(s for _, s in rows), np.uint32).reshape(len(rows), HASHES), least)
            a, b = zip(*[(rows[k][0], rows[c][0]) for k, c in enumerate(label) if k != c], strict=True) if (label != np.arange(len(rows))).any() else ((), ())
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    candidate_edges = units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(prune, "a binary, b binary")
    same_place = nodes.where("sig IS NOT NULL").join(places, "sig").where("key != place").select(F.col("key").alias("a"), F.col("place").alias("b"))
    clusters = components(candidate_edges.unionByName(same_place))

    # Exact verification inside the clusters: one text for each node, from the row with its least id.
    known = pinned(clusters.withColumnRenamed("node", "key").join(nodes.select("key", "least_id", "copies", "bytes"), "key"), "clustered")
    # One row a cluster or class, dealt anew so that adaptive execution may split the rows of a large one.
    cluster_size = known.groupBy("root").agg(F.count("*").alias("size"), F.sum("bytes").alias("all_bytes")).repartition("root", "size")
    inside = known.join(cluster_size, "root")
    asked = KeyFilter.of(known, "key").passing(base, "key")  # only these texts are shuffled
    one_text = asked.alias("d").join(inside.alias("c"), (F.col("d.key") == F.col("c.key")) & F.col("d.doc_id").eqNullSafe(F.col("c.least_id"))).select("c.root", "c.size", "c.all_bytes", "c.key", "c.copies", "d.text")
    cells = tiled(one_text, "size", "key", F.col("all_bytes")).select("root", "i", "j", "t", "key", "copies", "text")
    cell_keys = ["root", "i", "j"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in grouped(batches, 3):
            rows = sorted({r[1]: r for r in rows}.values(), key=lambda r: r[1])  # repeated rows of one id carry the same text
            on = linked(exact_grams([r[3] for r in rows], n), threshold)
            np.fill_diagonal(on, False)
            tile = np.array([r[0] for r in rows])
            if i != j:  # pairs within a tile are counted in that tile's own unit
                on &= tile[:, None] != tile[None, :]
            copies = np.array([r[2] for r in rows], np.int64)
            links = on @ copies
            label = reached(on)
            names = [r[1] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([names[k] for k in label], pa.binary()), pa.array(links)], names=["a", "b", "links"])

    verified = pinned(cells.repartition(*cell_keys).sortWithinPartitions(*cell_keys).mapInArrow(verify, "a binary, b binary, links long"), "links")
    classes = components(verified.select("a", "b"))
    links = verified.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    node_class = nodes.select("key", "least_id", "copies").join(classes.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    node_class = node_class.select("key", "least_id", "copies", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of_class = node_class.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size")).repartition("root", "class_size")
    final = pinned(node_class.join(of_class, "root").select("key", F.col("root").alias("class_key"), "class_id", "class_size", "n_links"), "classes")
    return base.select("doc_id", "key").join(final, "key").select("doc_id", "class_id", "class_size", "n_links", F.col("key").alias("text_key"), "class_key")


def reached(on: np.ndarray) -> np.ndarray:
    """For each row the first row of its connected part."""
    label = np.full(len(on), -1)
    for first in range(len(on)):
        if label[first] >= 0:
            continue
        label[first] = first
        frontier = np.array([first])
        while len(frontier):
            near = np.flatnonzero(on[frontier].any(0) & (label < 0))
            label[near] = first
            frontier = near
    return label


def one_of_each(docs: DataFrame, classes: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """The rows of ``docs`` with one left of each class: the one with the least id that isn't null (the first text among equal ids)."""
    found = classes(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    chosen = found.groupBy("class_key", "class_id").agg(F.min("text_key").alias("chosen")).select(F.col("class_id").alias("id"), "chosen")
    # Only rows repeated as a whole, id and text alike, can still be double. A row travels as one struct, so no name clashes.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"))
    kept = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("chosen")), "left_semi")
    return kept.dropDuplicates(["doc_id", "key"]).select(*(F.col("row")[c].alias(c) for c in docs.columns))
