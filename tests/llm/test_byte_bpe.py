import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from seqloom.llm import byte_bpe as b

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, "  \n\n x \x1c\x1d y\x0b\x0c \x85 \xa0　 z", "zażółć gęślą 漢字かな 👩‍👩‍👧 'S's'LL", "a" * 5000, "don't  stop   ", "​﻿ x", "x\x1f1\x1e", "ab" * 40_000, "<|endoftext|>", " lead", "a  b", "a \n b", "x\n y", "tail ", "end\n", "form\x0cfeed x", "nb\u00a0 z", "x .\ny ,z (q) 12 3a"]


@pytest.fixture(scope="module")
def oracle():
    import base64

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(c) for a, c in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash():
    for n in (0, 1, 2, 3, 50, 1000):
        keys = [f"k{i}".encode() for i in range(n)]
        h = b.PerfectHash(keys)
        assert [h.get(k) for k in keys] == list(range(n))
        assert h.get(b"absent") == -1
        assert all(k is not None for k in h.key_at)  # minimal: no slot is empty
    with pytest.raises(ValueError):
        b.PerfectHash([b"x", b"x", b"x"])


def test_against_library(spark, oracle):
    assert b.PATTERN == public_tokenizers.PATTERN
    docs = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(None, "hello world", "x"), (0, "", "en"), (0, "", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, token_ids string")
    rows = b.round_trip(df, PATH).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows), key=str)
    want = []
    for i, t, _ in docs:
        ids = oracle.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    for r in b.decode(b.encode(df, PATH), PATH).collect():
        assert list(r.token_ids) == oracle.encode_ordinary(bytes(r.decoded).decode())
    assert b.encode(df.limit(0), PATH).count() == b.round_trip(df.limit(0), PATH).count() == 0


def test_real_texts(spark, oracle):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in b.decode(b.encode(docs, PATH), PATH).join(docs, "doc_id").collect():
        assert list(r.token_ids) == oracle.encode_ordinary(r.text)
        assert bytes(r.decoded) == r.text.encode()


def test_other_patterns(oracle):
    own = b.load(PATH, r"\S+|\s+")
    assert own.decode(own.encode_batch(["some text  here", None, ""])[0]) == b"some text  here"
