"""Byte-level BPE encoding and decoding by ranks.

Two tiers. A minimal perfect hash over the vocabulary's byte strings resolves a whole pre-token in one probe. A
pre-token that is not in the vocabulary is merged from its bytes: a doubly linked list of parts and a heap of
(rank, position), so a pre-token of n bytes costs O(n log n) and not O(n^2).

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows give repeated rows; an empty
table gives an empty table; texts of any length are encoded whole (memory follows the longest text); further columns
of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.pieces import Pieces, Runs, gathered

#: Fixed value: how a text is cut into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE, FREQUENT = 1024, 100_000


class PerfectHash:
    """Minimal perfect hash (hash, displace) from ``n`` distinct byte strings to their positions.

    Keys fall into buckets of three on average. The largest buckets go first; each looks for a displacement that puts
    all its keys on free slots. Buckets of one key take any free slot, noted as a negative displacement.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 3)
        self.displacement = [0] * self.buckets
        self.key_at: list[bytes | None] = [None] * n
        self.value_at = [0] * n
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        places = [self._place(k) for k in keys]
        for i, (bucket, _, _) in enumerate(places):
            members[bucket].append(i)
        taken = bytearray(n)
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        for at, bucket in enumerate(order):
            inside = members[bucket]
            if len(inside) < 2:
                break
            d = 0
            while True:
                slots = {self._slot(places[i], d) for i in inside}
                if len(slots) == len(inside) and not any(taken[s] for s in slots):
                    break
                d += 1
                if d > 50 * n:
                    raise ValueError("repeated keys")
            self.displacement[bucket] = d
            for i in inside:
                self._store(self._slot(places[i], d), keys[i], i, taken)
        else:
            at = len(order)
        free = iter([s for s in range(n) if not taken[s]])
        for bucket in order[at:]:
            for i in members[bucket]:
                slot = next(free)
                self.displacement[bucket] = -slot - 1
                self._store(slot, keys[i], i, taken)

    def _place(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h >> 64) % self.buckets, h & 0xFFFFFFFF, (h >> 32 & 0xFFFFFFFF) | 1

    def _slot(self, place: tuple[int, int, int], d: int) -> int:
        return ((place[1] + d * place[2]) * 0x9E3779B97F4A7C15 >> 24 & 0xFFFFFFFF) % self.n

    def _store(self, slot: int, key: bytes, value: int, taken: bytearray) -> None:
        taken[slot] = 1
        self.key_at[slot] = key
        self.value_at[slot] = value

    def get(self, key: bytes) -> int:
        """The key's position, or -1: one probe and one comparison."""
        if not self.n:
            return -1
        place = self._place(key)
        d = self.displacement[place[0]]
        slot = -d - 1 if d < 0 else self._slot(place, d)
        return self.value_at[slot] if self.key_at[slot] == key else -1


class ByteBpe:
    """Encoder and decoder over a rank file (base64 token, space, rank a line)."""

    def __init__(self, tokens: dict[bytes, int], pattern: str = PATTERN):
        import regex

        keys = list(tokens)
        self.hash = PerfectHash(keys)
        self.rank_at = [tokens[k] for k in keys]
        self.rank_of_part = tokens  # for the parts of a miss; whole pre-tokens go through the perfect hash
        self.rank_of_pair = [tokens.get(bytes((x, y)), -1) for x in range(256) for y in range(256)]  # for its bytes
        self.find = regex.compile(pattern).findall
        size = max(tokens.values(), default=-1) + 1
        spelled: list[bytes] = [b""] * size
        for k, r in tokens.items():
            spelled[r] = k
        self.bytes_of = np.frombuffer(b"".join(spelled), np.uint8)
        self.length_of = np.array([len(x) for x in spelled], np.int64)
        self.start_of = np.cumsum(self.length_of) - self.length_of
        self.frequent: dict[str, tuple[int, ...]] = {}  # the first pre-tokens met
        # Cutting at spaces holds for this pattern; other patterns see whole texts.
        self.pieces = Pieces(self.whole, self._after_space) if pattern == PATTERN else None

    def rank(self, piece: bytes) -> int:
        at = self.hash.get(piece)
        return self.rank_at[at] if at >= 0 else -1

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.rank(piece)
        return (whole,) if whole >= 0 else tuple(self.merge(piece))

    def merge(self, piece: bytes) -> list[int]:
        """Merges the adjacent parts of lowest rank, leftmost first, until none is in the vocabulary."""
        n, rank = len(piece), self.rank_of_part.get
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n
        pairs = self.rank_of_pair
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := pairs[piece[i] << 8 | piece[i + 1]]) >= 0]
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            _, i, stop = pop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue  # one of the two parts has been merged since
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    push(heap, (r, i, end[stop]))
            if (b := before[i]) >= 0 and (r := rank(piece[b:stop])) is not None:
                push(heap, (r, b, stop))
        out, i = [], 0
        while i < n:
            out.append(self.rank_of_part[piece[i : end[i]]])
            i = end[i]
        return out

    def whole(self, texts: list[str]) -> Runs:
        """Ids of texts end to end, and how many each has: pre-token by pre-token, equal ones looked up once."""
        known, here = self.frequent, {}
        ids: list[int] = []
        width = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            before = len(ids)
            for p in self.find(text):
                x = known.get(p) or here.get(p)
                if x is None:
                    x = self.encode_piece(p.encode())
                    (known if len(known) < FREQUENT else here)[p] = x
                ids += x
            width[k] = len(ids) - before
        return np.array(ids, np.uint32), width

    def _after_space(self, distinct: list[str]) -> Runs:
        return self.whole([f" {p}" for p in distinct])

    def encode_batch(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of each text (null counts as empty)."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if self.pieces:
            return self.pieces.encode(texts)
        ids, each = self.whole([t or "" for t in texts.to_pylist()])
        return np.split(ids, np.cumsum(each)[:-1]) if len(each) else []

    def decode(self, ids: np.ndarray) -> bytes:
        return gathered(self.bytes_of, self.start_of[ids], self.length_of[ids]).tobytes()


@lru_cache(maxsize=4)
def load(path: str, pattern: str = PATTERN) -> ByteBpe:
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return ByteBpe({base64.b64decode(a): int(b) for a, b in pairs}, pattern)


def encode(docs: DataFrame, rank_file: str, *, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """``doc_id``, ``token_ids array<int>``: one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_file, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                found = bpe.encode_batch(batch.column(1))
                offsets = pa.array(np.cumsum([0] + [len(x) for x in found]), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "token_ids"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, token_ids array<int>")


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """``doc_id``, ``token_ids``, ``decoded binary`` from the output of :func:`encode`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_file)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                out = [bpe.decode(x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32)) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "token_ids", "decoded"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, token_ids array<int>, decoded binary")


def round_trip(docs: DataFrame, rank_file: str, *, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded, then decoded from those ids, in one worker process a task.

    The same as digests of :func:`decode` over :func:`encode`, without the ids' way through the JVM in between.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_file, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                found = bpe.encode_batch(batch.column(1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in found], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
