"""Documents packed into sequences of a fixed number of tokens, with a proof of how many sequences are needed.

Tokenised documents are cut where they are longer than a sequence; whole sequences need no packing, the other pieces do:

1. Pieces are dealt over partitions of bounded size, and each partition packs its own by best fit, longest first.
2. Dual-feasible functions bound how many sequences any packing of given lengths needs: a function f of lengths to [0, 1] whose sums over
   any lengths that fit into one sequence are at most 1 makes the sum of f over all pieces a lower bound. Sums add up over partitions.
3. The function with the best bound for all pieces certifies partitions: each keeps its sequences of greatest worth, as many as the
   function proves to be needed for what they hold, up to a small share of one sequence. What is beyond that is its gap.
4. Partitions exchange the documents of their gaps: these are dealt anew, over as few partitions as can hold them, and packed again, until
   one partition holds them all or a round saves nothing. A round counts only if it takes fewer sequences than were given up.

Lengths are whole numbers up to the sequence length, so a partition's pieces are counted by length and all bounds are exact integers.

Defined results: null text counts as empty (its one piece is the end id); rows repeat as often as given; a null id stays null and its
rows are packed like any other; no documents, no sequences; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import dealt, pinned, spare
from seqloom.llm.token_files import encoder

SLICE = 512
#: Pieces that one task packs (in a fraction of a second); more are packed by more tasks.
TASK_PIECES = 100_000
#: Exchanges at most; each but the last one saves at least one sequence.
ROUNDS = 20
#: What of a sequence a partition may keep unproved.
SHARE = 1 / 32


@lru_cache(maxsize=2)
def feasible(capacity: int, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Dual-feasible functions of lengths 0 to ``capacity``: a table of integers, a row a function, and what a whole sequence is
    worth in each.

    Identity; the step functions that leave out pieces below a limit and count those that leave less than it as whole; the rounding
    functions by (k + 1) and by multiples of a length.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    rows, unit = [x], [capacity]
    for low in sorted({1 + capacity * k // (2 * most) for k in range(most + 1)} & set(range(1, capacity // 2 + 1))):
        rows.append(np.where(x > capacity - low, capacity, np.where(x >= low, x, 0)))
        unit.append(capacity)
    for k in range(1, most + 1):
        rows.append(np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity))
        unit.append(k * capacity)
    for step in sorted({max(1, capacity // k) for k in range(2, most + 1)} | {1 + capacity * k // (2 * most) for k in range(1, most)}):
        if step > capacity // 2:
            continue
        high = capacity // step
        rows.append(np.where(2 * x > capacity, 2 * (high - (capacity - x) // step), np.where(2 * x == capacity, high, 2 * (x // step))))
        unit.append(2 * high)
    return np.stack(rows), np.array(unit, np.int64)


def strongest(counts: np.ndarray, capacity: int) -> tuple[int, np.ndarray, int]:
    """How many sequences pieces need at least, given how many there are of each length (0 to ``capacity``), and the function
    that proves it: what each length is worth, and a whole sequence."""
    table, unit = feasible(capacity)
    worth = table @ counts
    best = int(np.argmax(worth / unit))
    return max(-(-int(s) // int(u)) for s, u in zip(worth, unit, strict=True)), table[best], int(unit[best])


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences: longest first, each into the fullest one that has room."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by the room they have
    some = 0  # bit r: there is a sequence with room r
    n = 0
    order = np.argsort(-lengths, kind="stable")
    for at, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if fitting := some >> size:
            left = size + (fitting & -fitting).bit_length() - 1
            s = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
        else:
            s, left, n = n, capacity, n + 1
        sequence[at], offset[at] = s, capacity - left
        left -= size
        if left:
            room[left].append(s)
            some |= 1 << left
    return sequence, offset, n


def certified(lengths: np.ndarray, sequence: np.ndarray, n: int, worth: np.ndarray, unit: int, share: float = SHARE) -> np.ndarray:
    """The sequences that stay: those worth most, as many as the function proves to be needed for what they hold, up to
    ``share`` of a sequence."""
    each = np.bincount(sequence, worth[lengths], n)  # whole numbers far below 2 ** 53
    order = np.lexsort((-np.bincount(sequence, lengths, n), -each))
    return order[np.cumsum(unit - each[order]) <= share * unit]


def pieces_of(docs: DataFrame, tokenizer_file: str, *, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if wanted, ``ids``: each document's ids and its end id in pieces of at most
    ``capacity``, of which only the first one of a cut document may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_file, True), np.array([end_id], np.uint32)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                rows, cut = [], []
                for i, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
                    ids = np.concatenate((ids, end)).astype("<u4")
                    raw = ids.tobytes()
                    n, start = len(ids), 0
                    for k in range(-(-n // capacity)):
                        stop = (n - 1) % capacity + 1 + k * capacity
                        rows.append((i, k, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
                        if with_ids:
                            cut.append(ids[start:stop])
                        start = stop
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)]
                if with_ids:
                    columns.append(pa.array(cut, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def packed(items: DataFrame, width: int, capacity: int, salt: int, worth: np.ndarray, unit: int) -> DataFrame:
    """``item, length, sequence, offset, stays``: the pieces of each of ``width`` partitions packed on their own. A sequence is named
    by the item that it starts with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), pa.schema([("item", pa.int64()), ("length", pa.int32()), ("slot", pa.int64())]))
        slots = got.column("slot").to_numpy()
        for slot in np.unique(slots):  # one, but where slots beyond some thousands share a partition
            mine = got.filter(pa.array(slots == slot)).sort_by("item")
            item, lengths = mine.column("item").to_numpy(), mine.column("length").to_numpy().astype(np.int64)
            sequence, offset, n = best_fit(lengths, capacity)
            stays = np.isin(sequence, certified(lengths, sequence, n, worth, unit))
            name = np.zeros(n, np.int64)
            name[sequence[offset == 0]] = item[offset == 0]
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(lengths.astype(np.int32)), pa.array(name[sequence]), pa.array(offset), pa.array(stays)], names=["item", "length", "sequence", "offset", "stays"])

    slotted = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(width)).alias("slot"))
    return dealt(slotted, width, F.col("slot")).mapInArrow(run, "item long, length int, sequence long, offset long, stays boolean")


def pack(pieces: DataFrame, capacity: int = 2048, *, width: int | None = None, task_pieces: int = TASK_PIECES) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``; no sequence has a gap.

    What partitions exchange is an item number and a length; other columns stay in the written table until the end.
    """
    item, sequence, offset = spare(pieces, "item", "sequence", "offset")
    rows = pinned(pieces.withColumn(item, F.monotonically_increasing_id()), "pieces")
    whole, rest = rows.where(F.col("length") >= capacity), rows.where(F.col("length") < capacity)
    items = rest.select(F.col(item).alias("item"), F.col("length").cast("int").alias("length"))
    counts = lengths_of(items, capacity)
    _, *proof = strongest(counts, capacity)
    n = int(counts.sum())
    width = max(1, width or 1, -(-n // task_pieces))
    now, placed = pinned(packed(items, width, capacity, 0, *proof), "packed"), []
    first = F.count(F.when(F.col("offset") == 0, 1))  # a row a sequence
    for k in range(1, ROUNDS + 1):
        gap = now.where(~F.col("stays"))
        n, given = gap.agg(F.count("*"), first).first()
        again = None
        if width > 1 and n and k < ROUNDS:
            width = min(width, -(-n // task_pieces))
            again = pinned(packed(gap.select("item", "length"), width, capacity, k, *proof), "packed")
        if again is None or again.agg(first).first()[0] >= given:
            placed.append(now)
            break
        placed.append(now.where("stays"))
        now = again
    where = reduce(DataFrame.unionByName, placed).select(F.col("item").alias(item), F.col("sequence").alias(sequence), F.col("offset").alias(offset))
    alone = whole.select("*", F.col(item).alias(sequence), F.lit(0).cast("long").alias(offset))
    both = rest.join(where, item).unionByName(alone)
    return both.select(*pieces.columns, F.col(sequence).alias("sequence_id"), F.col(offset).alias("offset"))


def lengths_of(pieces: DataFrame, capacity: int) -> np.ndarray:
    """How many pieces have each length: a row a length is collected."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r.length] = r.n
    return counts


def lower_bound(pieces: DataFrame, capacity: int = 2048) -> int:
    """How many sequences any packing of all pieces needs."""
    return strongest(lengths_of(pieces, capacity), capacity)[0]


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, from pieces with their ``ids``."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a sequence's tokens at most
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(held, lambda p: p["ids"])).alias("ids"))
