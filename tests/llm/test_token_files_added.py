"""Texts that hold added tokens, against the library as it comes."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from seqloom.llm import queries
from seqloom.llm import token_files as f

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["a<|endoftext|>b", "<|endoftext|> x <|endoftext|>", "x <|endoftext|>", "a <|endo ftext|> b", "<|endoftext|>", "", None, "one two  three", "q <|endoftext|><|endoftext|>\n z", "b two", "<|endoftext|"]


def library():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_added_tokens_are_ids():
    ids = library()
    assert ids(TEXTS[0]) == [64, 50256, 65]
    for t, got in zip(TEXTS, f.PieceEncoder(PATH, added_tokens=True).encode(pa.array(TEXTS)), strict=True):
        assert got.tolist() == ids(t), t


def test_registered_query(spark, tmp_path):
    ids, at = library(), 0
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for (i, t), r in zip(enumerate(TEXTS), sorted(queries.op8_token_files(spark, str(tmp_path)).collect(), key=lambda r: r.start), strict=True):
        want = np.array([*ids(t), 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
