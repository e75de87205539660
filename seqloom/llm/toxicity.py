"""Toxicity by a factorization machine over hashed terms.

A text becomes the set of its lower-cased words and of longer words' first letters, hashed to ``2 ** bits`` columns. The score is
``sigmoid(w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2))``: beside a weight for each term, the factors give a weight
to each pair of terms, so an insult beside a group's name may count for more than both apart. The machine is fitted by
AdaGrad on a bounded sample of labelled rows (``per_class`` ids of each class at most, chosen by a hash of the id, and one text of
each); terms learn that tell toxic texts by themselves, or beside another term in what the former leave wrong. Scoring reads every whole text, holds one batch at a time and
shuffles nothing.

Defined results: null text counts as empty and is scored (by the bias alone); null labels and labels of unknown documents
are ignored; a document with several labels counts as toxic if one of them says so; an id with several texts is learnt from by
the one of least digest; without rows of both classes every score is 0; repeated rows get equal scores; rows with a null id are scored but never learnt from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
SLICE = 512
#: Words whose columns a task remembers: the first ones it meets, so frequent words are among them and memory is bounded.
CACHE = 100_000
#: A longer word also counts as its first letters, so forms of one stem learn together.
STEM = 4


@dataclass(frozen=True)
class Machine:
    bits: int
    bias: float
    weights: np.ndarray  # float32 [2 ** bits]
    factors: np.ndarray  # float32 [2 ** bits, k]


def terms(text: str | None, bits: int, cache: dict[str, tuple[int, ...]]) -> np.ndarray:
    """The distinct hashed terms of a text, ascending."""
    if not text:
        return np.zeros(0, np.int32)
    mask = (1 << bits) - 1
    out: list[int] = []
    for w in set(WORD.findall(text.lower())):
        if (c := cache.get(w)) is None:
            c = (xxhash.xxh3_64_intdigest(w) & mask,)
            if len(w) > STEM:
                c += (xxhash.xxh3_64_intdigest(w[:STEM] + "*") & mask,)
            if len(cache) < CACHE:
                cache[w] = c
        out += c
    return np.unique(np.array(out, np.int32))


def raw_scores(machine: Machine, columns: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Scores before the sigmoid of rows given as one array of columns and the rows' ends."""
    out = np.full(len(stops), machine.bias, np.float64)
    if len(columns):
        # Columns without any weight change nothing: leaving them out spares most of the sums.
        live = np.flatnonzero((machine.weights != 0) | (machine.factors != 0).any(1))
        slot = np.full(len(machine.weights), -1, np.int32)
        slot[live] = np.arange(len(live), dtype=np.int32)
        at = slot[columns]
        row = np.repeat(np.arange(len(stops)), np.diff(np.concatenate(([0], stops))))
        row, at = row[at >= 0], at[at >= 0]
        n, v = len(stops), machine.factors[live]
        out += np.bincount(row, machine.weights[live][at].astype(np.float64), n)
        out -= 0.5 * np.bincount(row, (v.astype(np.float64) ** 2).sum(1)[at], n)
        for f in range(v.shape[1]):
            out += 0.5 * np.bincount(row, v[:, f].astype(np.float64)[at], n) ** 2
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.where(x == -np.inf, 0.0, 1 / (1 + np.exp(-np.clip(x, -35, 35))))


def marginal_values(rows: list[np.ndarray], labels: np.ndarray, size: int, min_docs: int, least_z: float) -> np.ndarray:
    """How far a term's share of toxic texts is from its share of the others, in standard errors: 0 up to ``least_z``, 1 from
    ``least_z + 8`` on."""
    positive = labels.sum()
    seen = np.bincount(np.concatenate(rows), minlength=size)
    toxic = np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y > 0]), minlength=size)
    share, other = toxic / positive, (seen - toxic) / (len(labels) - positive)
    spread = np.sqrt(np.maximum(seen / len(labels) * (1 - seen / len(labels)), 1e-12) * (1 / positive + 1 / (len(labels) - positive)))
    return np.clip((np.abs(share - other) / spread - least_z) / 8, 0, 1) * (seen >= min_docs)


#: Errors below this say nothing of what is still to be learnt.
CLEAR, BLOCK = 0.05, 512


def pair_values(rows: list[np.ndarray], error: np.ndarray, variance: np.ndarray, size: int, least_z: float) -> np.ndarray:
    """Terms that mean something beside another one: of each term the pair whose rows' errors add up to most standard errors, 0 up
    to ``least_z``, 1 from ``least_z + 8`` on. ``error`` and ``variance`` are those of a machine that doesn't know such terms.

    A pair that fewer than ``least_z ** 2`` texts hold can't get there, so rarer terms are left out. Of all pairs of the others the
    sums are products of blocks of the table of texts and terms.
    """
    out = np.zeros(size)
    unclear = np.flatnonzero(np.abs(error) >= CLEAR)
    if not len(unclear):
        return out
    seen = np.bincount(np.concatenate([rows[k] for k in unclear]), minlength=size)
    names = np.flatnonzero(seen >= least_z**2)
    place = np.full(size, -1)
    place[names] = np.arange(len(names))
    table = np.zeros((len(unclear), len(names)), np.uint8)
    for k, at in enumerate(unclear):
        mine = place[rows[at]]
        table[k, mine[mine >= 0]] = 1
    e, v = error[unclear].astype(np.float32), variance[unclear].astype(np.float32)
    best = np.zeros(len(names))
    for i in range(0, len(names), BLOCK):
        left = table[:, i : i + BLOCK].astype(np.float32)
        for j in range(i, len(names), BLOCK):
            right = table[:, j : j + BLOCK].astype(np.float32)
            z = np.abs((left * e[:, None]).T @ right) / np.sqrt(np.maximum((left * v[:, None]).T @ right, 1.0))
            if i == j:
                np.fill_diagonal(z, 0)
            best[i : i + BLOCK] = np.maximum(best[i : i + BLOCK], z.max(1))
            best[j : j + BLOCK] = np.maximum(best[j : j + BLOCK], z.max(0))
    out[names] = np.clip((best - least_z) / 8, 0, 1)
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, *, bits: int, min_docs: int = 3, least_z: float = 2.5, least_pair_z: float = 7.0, **options) -> Machine:
    """Two passes of ``descend``. The first learns from terms that mean something by themselves. What it gets wrong is then searched
    for pairs of terms, whatever each of them means alone, and the second learns from both kinds. Most words mean nothing and would
    be learnt by heart, so a term's value (0 to 1, by how surely it means something) is multiplied into its weight and factors."""
    size = 1 << bits
    if not 0 < labels.sum() < len(labels):
        return Machine(bits, -np.inf, np.zeros(size, np.float32), np.zeros((size, options.get("k", 4)), np.float32))
    value = marginal_values(rows, labels, size, min_docs, least_z)
    first = descend(rows, labels, value, bits=bits, **options)
    guess = sigmoid(raw_scores(first, np.concatenate(rows), np.cumsum([len(r) for r in rows])))
    weight = balanced(labels)
    paired = pair_values(rows, (labels - guess) * weight, guess * (1 - guess) * weight**2, size, least_pair_z)
    if not (paired > value).any():
        return first
    return descend(rows, labels, np.maximum(value, paired), bits=bits, **options)


def balanced(labels: np.ndarray) -> np.ndarray:
    """Both classes weigh the same."""
    positive = labels.sum()
    return np.where(labels > 0, len(labels) / (2 * positive), len(labels) / (2 * (len(labels) - positive)))


def descend(rows: list[np.ndarray], labels: np.ndarray, value: np.ndarray, *, bits: int, k: int = 4, epochs: int = 12, batch: int = 128, rate: float = 0.3, decay: float = 1e-4, seed: int = 11) -> Machine:
    """AdaGrad on the logistic loss. Values are multiplied into the weights and factors at the end, so that scoring needs only which
    terms a text has."""
    size = 1 << bits
    w, v = np.zeros(size, np.float32), np.zeros((size, k), np.float32)
    rng = np.random.default_rng(seed)
    kept = value > 0
    rows = [r[kept[r]] for r in rows]
    v[kept] = rng.normal(0, 0.01, (int(kept.sum()), k))
    weight = balanced(labels)
    gw, gv, bias, gb = np.full(size, 1e-6), np.full((size, k), 1e-6), 0.0, 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            cols = np.concatenate([rows[i] for i in pick])
            count = np.array([len(rows[i]) for i in pick])
            row = np.repeat(np.arange(len(pick)), count)
            x, vx = value[cols], v[cols] * value[cols, None]
            sums = np.stack([np.bincount(row, vx[:, f], len(pick)) for f in range(k)], 1)
            score = bias + np.bincount(row, w[cols] * x, len(pick)) + 0.5 * ((sums**2).sum(1) - np.bincount(row, (vx**2).sum(1), len(pick)))
            error = (sigmoid(score) - labels[pick]) * weight[pick] / len(pick)
            used, inverse = np.unique(cols, return_inverse=True)
            dw = np.bincount(inverse, error[row] * x, len(used)) + decay * w[used]
            gw[used] += dw**2
            w[used] -= (rate * dw / np.sqrt(gw[used])).astype(np.float32)
            for f in range(k):
                dv = np.bincount(inverse, error[row] * x * (sums[row, f] - vx[:, f]), len(used)) + decay * v[used, f]
                gv[used, f] += dv**2
                v[used, f] -= (0.2 * rate * dv / np.sqrt(gv[used, f])).astype(np.float32)
            db = float(error.sum())
            gb += db**2
            bias -= rate * db / gb**0.5
    folded = value.astype(np.float32)
    return Machine(bits, bias, w * folded, v * folded[:, None])


def train(docs: DataFrame, labels: DataFrame, *, bits: int = 18, per_class: int = 4000, exclude_fold: int = 1, folds: int = 3, **options) -> Machine:
    """Fits on at most ``per_class`` toxic and as many other labelled rows whose crc32(doc_id) mod ``folds`` isn't ``exclude_fold``."""
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != exclude_fold))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    by_hash = (F.xxhash64("doc_id"), "doc_id")
    chosen = usable.where("toxic = 1").orderBy(*by_hash).limit(per_class).unionByName(usable.where("toxic = 0").orderBy(*by_hash).limit(per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for b in batches:
            found = [terms(t, bits, cache) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "columns"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    # The sample is bounded by 2 * per_class short rows: a broadcast of proven size.
    met = picked.join(F.broadcast(chosen), "doc_id")
    # However often an id comes, one of its texts is learnt from: that of least digest.
    one = met.groupBy("doc_id", "toxic").agg(F.min_by("text", F.md5(F.coalesce("text", F.lit("")))).alias("text"))
    sample = one.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, columns array<int>")
    got = sample.toArrow().sort_by([("doc_id", "ascending")])
    y, rows = got.column("toxic").to_numpy().astype(np.float64), arrays_of(got.column("columns"))
    del got
    pa.default_memory_pool().release_unused()
    return fit(rows, y, bits=bits, **options)


def arrays_of(lists: pa.ChunkedArray) -> list[np.ndarray]:
    """Lists of numbers as parts of one array: the driver makes no object of each number, which would stay in its memory."""
    stops = np.cumsum(pc.list_value_length(lists).to_numpy())
    return np.split(pc.list_flatten(lists).to_numpy(), stops)[: len(stops)]


def shared_machine(spark: SparkSession, machine: Machine):
    """The machine on all executors: what it holds is bounded by the columns in use."""
    live = np.flatnonzero((machine.weights != 0) | (machine.factors != 0).any(1)).astype(np.int32)
    return spark.sparkContext.broadcast((machine.bits, machine.bias, live, machine.weights[live], machine.factors[live]))


def unpacked(packed: tuple) -> Machine:
    bits, bias, at, weights, factors = packed
    w, v = np.zeros(1 << bits, np.float32), np.zeros((1 << bits, factors.shape[1]), np.float32)
    w[at], v[at] = weights, factors
    return Machine(bits, bias, w, v)


def scores_of(machine: Machine, texts: list[str | None], cache: dict[str, tuple[int, ...]]) -> np.ndarray:
    found = [terms(t, machine.bits, cache) for t in texts]
    return sigmoid(raw_scores(machine, np.concatenate(found) if found else np.zeros(0, np.int32), np.cumsum([len(x) for x in found])))


def score(docs: DataFrame, machine: Machine, *, threshold: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs``."""
    shared = shared_machine(docs.sparkSession, machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, cache = unpacked(shared.value), {}
        for big in batches:
            for start in range(0, big.num_rows, SLICE):
                b = big.slice(start, SLICE)
                s = scores_of(whole, b.column(1).to_pylist(), cache)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, machine: Machine, *, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they are."""
    shared, at = shared_machine(docs.sparkSession, machine), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, cache = unpacked(shared.value), {}
        for big in batches:
            for start in range(0, big.num_rows, SLICE):
                b = big.slice(start, SLICE)
                yield b.filter(pa.array(scores_of(whole, b.column(at).to_pylist(), cache) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(folds: int = 3, fold: int = 1):
    """True for rows that the machine never learns from; a null id has no remainder and is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))
