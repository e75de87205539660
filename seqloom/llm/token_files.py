"""Token ids in binary files: fixed-width bit packing in frames that can be read one by one or at random.

Encoding uses the tokenizers library; equal pieces of texts go to it once (see ``pieces``). With ``added_tokens`` ids are those
of the library as it comes: an added token (such as ``<|endoftext|>``) that a text holds is one id, and such texts go to the
library whole. Without, added tokens inside texts are encoded like any other characters.

A file is a sequence of frames; all integers are little-endian:

    magic 'SQF1' | bits u8 | 3 zero bytes | shard u32 | frame u32 | documents u32 | ids u64 | first id within the shard u64 |
    block u32 | blocks u32 | payload bytes u64 |
    documents x (id i64, valid u8, ids u32) | blocks x byte offset u64 | payload | '\\n'

Every ``block`` ids start at a whole byte, at the listed offset, so id k is in block ``k // block`` at bit
``(k % block) * bits`` and any range unpacks by numpy without what is before it. ``bits`` is the least width that holds the
vocabulary. Frames hold about ``FRAME_IDS`` ids (a longer document has a frame of its own) and a file ``FRAMES`` frames, so neither
writing nor reading ever holds a whole shard. Spark's text writer puts the frames down as they are, in any store it can
write, and its commit protocol keeps files whole when executors are lost.

Defined results: null text counts as empty and gives the end id alone; null ids come first, equal ids are ordered by text;
repeated rows are written repeatedly; an empty table gives no documents; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import fresh_path, pinned, shuffle_width
from seqloom.llm.pieces import MARK, Pieces, Runs

HEAD = struct.Struct("<4sB3xIIIQQIIQ")
DOCUMENT = np.dtype([("id", "<i8"), ("valid", "u1"), ("ids", "<u4")])
FRAME_IDS, BLOCK, FRAMES = 1 << 16, 4096, 128
SLICE, JOINED = 1024, 8192


class PieceEncoder:
    """Ids of whole texts by the library, with equal pieces of a batch encoded once."""

    def __init__(self, path: str, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if added_tokens or not t.special]
        mark = self.whole([MARK])[0]
        # Other kinds of tokenizers don't cut before spaces: their texts all go to the library whole.
        cuts = len(mark) == 1 and "ByteLevel" in str(self.tokenizer.pre_tokenizer) and not any(MARK in t for t in added)
        self.mark = int(mark[0]) if cuts else None
        self.pieces = Pieces(self.whole, self._after_space, added=added)

    def whole(self, texts: list[str]) -> Runs:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        width = np.array([len(x) for x in found], np.int64)
        return np.array([i for x in found for i in x], np.uint32), width

    def _after_space(self, distinct: list[str]) -> Runs:
        """Some thousands at a time go to the library as one text with a mark between them: a pre-token of its own between a
        piece's end and the next one's space."""
        ids, each = [], []
        for at in range(0, len(distinct), JOINED):
            run = self.whole([" " + f"{MARK} ".join(distinct[at : at + JOINED])])[0]
            marks = np.flatnonzero(run == self.mark)
            ids.append(run[run != self.mark])
            each.append(np.diff(np.concatenate(([-1], marks, [len(run)]))) - 1)
        return np.concatenate(ids), np.concatenate(each)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        if self.mark is not None:
            return self.pieces.encode(texts)
        ids, each = self.whole([t or "" for t in texts.to_pylist()])
        return np.split(ids, np.cumsum(each)[:-1]) if len(each) else []

    def bits(self) -> int:
        return max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())


@lru_cache(maxsize=2)
def encoder(path: str, added_tokens: bool) -> PieceEncoder:
    return PieceEncoder(path, added_tokens)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` each, lowest bit first, filled up to a whole byte."""
    if bits % 8 == 0 and bits <= 32:
        return np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    cells = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(cells.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes | memoryview, count: int, bits: int, skip: int = 0) -> np.ndarray:
    """``count`` ids from id ``skip`` of a packed run on."""
    if bits % 8 == 0 and bits <= 32:
        wide = bits // 8
        cells = np.frombuffer(raw, np.uint8, count * wide, skip * wide).reshape(-1, wide)
        out = np.zeros((count, 4), np.uint8)
        out[:, :wide] = cells
        return out.view("<u4").ravel().copy()
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[skip * bits : (skip + count) * bits].reshape(count, bits)
    return (flat.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1).astype(np.uint32)


def frame(shard: int, number: int, first: int, docs: list[tuple[int | None, np.ndarray]], bits: int, block: int = BLOCK) -> bytes:
    """One frame without its final newline (the writer adds it)."""
    ids = np.concatenate([x for _, x in docs])
    listing = np.array([(i or 0, i is not None, len(x)) for i, x in docs], DOCUMENT)
    runs = [pack(ids[at : at + block], bits) for at in range(0, len(ids), block)]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs])))[:-1].astype("<u8")
    payload = b"".join(runs)
    head = HEAD.pack(b"SQF1", bits, shard, number, len(docs), len(ids), first, block, len(runs), len(payload))
    return b"".join((head, listing.tobytes(), offsets.tobytes(), payload))


class Frame:
    """A view of one frame in a file's bytes."""

    def __init__(self, raw: memoryview, at: int):
        magic, self.bits, self.shard, self.number, docs, self.ids, self.first, self.block, blocks, size = HEAD.unpack_from(raw, at)
        if magic != b"SQF1":
            raise ValueError(f"no frame at byte {at}")
        at += HEAD.size
        self.documents = np.frombuffer(raw, DOCUMENT, docs, at)
        at += docs * DOCUMENT.itemsize
        self.offsets = np.frombuffer(raw, "<u8", blocks, at)
        at += blocks * 8
        self.payload = raw[at : at + size]
        self.end = at + size + 1

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the frame: only their blocks are unpacked."""
        out = []
        while start < stop:
            b, skip = divmod(start, self.block)
            count = min(stop - start, self.block - skip)
            low = int(self.offsets[b])
            high = int(self.offsets[b + 1]) if b + 1 < len(self.offsets) else len(self.payload)
            out.append(unpack(self.payload[low:high], count, self.bits, skip))
            start += count
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def frames(raw: bytes) -> Iterator[Frame]:
    view, at = memoryview(raw), 0
    while at < len(view):
        f = Frame(view, at)
        yield f
        at = f.end


def write(docs: DataFrame, path: str, tokenizer_file: str, *, end_id: int = 2, shards: int | None = None, added_tokens: bool = False) -> None:
    """Writes the ids of all documents in ascending id order, ``end_id`` after each, as files under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), encoder(tokenizer_file, added_tokens)
        bits, end = max(enc.bits(), end_id.bit_length()), np.array([end_id], np.uint32)
        held: list[tuple[int | None, np.ndarray]] = []
        number = first = size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                out = []
                for i, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
                    if held and size + len(ids) + 1 > FRAME_IDS:
                        out.append(frame(shard, number, first, held, bits))
                        held, number, first, size = [], number + 1, first + size, 0
                    held.append((i, np.concatenate((ids, end))))
                    size += len(ids) + 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([frame(shard, number, first, held, bits)], pa.binary())], names=["frame"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = picked.repartitionByRange(shards or shuffle_width(docs.sparkSession), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    framed = ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    framed.write.option("lineSep", "\n").option("maxRecordsPerFile", FRAMES).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files alone; ``start`` counts from the first document of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows: list[tuple] = []
                for f in frames(b.column(0)[k].as_buffer()):
                    ids, at = f.read(0, f.ids), 0
                    for d in f.documents:
                        mine = ids[at : at + int(d["ids"])]
                        rows.append((f.shard, int(d["id"]) if d["valid"] else None, f.first + at, len(mine), zlib.crc32(mine.astype("<u4").tobytes())))
                        at += len(mine)
                columns = zip(*rows, strict=True) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 4), strict=True)], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    found = pinned(files.select("content").mapInArrow(run, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long"), "token-index")
    sizes = found.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    base = sizes.select("shard", (F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("shard")) - F.col("size")).alias("base"))  # a row a shard
    return found.join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer_file: str, **options) -> DataFrame:
    path = fresh_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer_file, **options)
    return read(docs.sparkSession, path)
