import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from seqloom.llm import token_files as f

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, " lead", "a  b", "a \n b", "x\n y", "tail ", "tab\t x", "nb  z", "　 w", "\x1c q", "<|endoftext|> x <|endoftext|>", "don't  stop", "zażółć 漢字 👩‍👩‍👧 'S's", "a" * 3000, "\n\nq\r\n r", "a b" * 40_000, "end\n", "form\x0cfeed x", "one", "x .\ny ,z (q) 12 3a", "tail\u3000"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 24, 31, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 10_000, dtype=np.uint64).astype(np.uint32)
    raw = f.pack(ids, bits)
    assert len(raw) == -(-len(ids) * bits // 8)
    assert (f.unpack(raw, len(ids), bits) == ids).all() and (f.unpack(raw, 77, bits, 501) == ids[501:578]).all()
    one = f.Frame(memoryview(f.frame(3, 4, 5, [(7, ids), (None, ids[:0])], bits, block=100) + b"\n"), 0)
    assert (one.read(0, len(ids)) == ids).all() and (one.read(95, 305) == ids[95:305]).all()
    assert (one.shard, one.number, one.first, one.documents["valid"].tolist()) == (3, 4, 5, [1, 0])


def test_pieces_give_the_ids_of_whole_texts(spark, library):
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).collect()]
    for t, ids in zip(texts, f.PieceEncoder(PATH).encode(pa.array(texts)), strict=True):
        assert ids.tolist() == library(t), t


@pytest.mark.parametrize("frame_ids", [1 << 16, 50])
def test_round_trip(spark, library, monkeypatch, frame_ids):
    monkeypatch.setattr(f, "FRAME_IDS", frame_ids)
    monkeypatch.setattr(f, "FRAMES", 3)
    rows = [(i * 10, t) for i, t in enumerate(TEXTS)] + [(None, "nothing"), (30, "b"), (30, "b"), (30, "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    got = sorted(f.write_and_read(df, PATH, shards=3).collect(), key=lambda r: r.start)
    at = 0
    for (i, t), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), got, strict=True):
        ids = np.array([*library(t), 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert f.write_and_read(df, PATH).count() == 0
