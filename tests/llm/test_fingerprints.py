import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from seqloom.llm import fingerprints as f

TEXTS = ["Plain ASCII\x1c TEXT [\\]^_`{|}~ @ \x7f", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ﬁ Straße ÉÀ　é ẞ Å ½ ㌔ ＡＢ İ ς", "a  b\t\nc ", "A b C", "\x1c x \x85y   z  ", "한글 한글", "ａｂ", "é", "é", "", "   ", "q̣̇", "q̣̇", "👩‍👩‍👧"]


def canon(text):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(t.split())


def order_of(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).digest())
    return sorted(rows, key=key)


def brute(rows):
    rows = [(i, t or "") for i, t in order_of(rows)]
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), canon(t), canon(e), float(canon(t) == canon(e)), float(canon(t) == canon(nxt))))
    return out


def agree(df, rows):
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in f.fingerprint(df).collect()), key=str)
    want = brute(rows)
    plain = lambda x: (x[0], x[1], x[2], x[5], x[6])
    assert sorted(map(plain, got), key=str) == sorted(map(plain, want), key=str)
    # the same equalities among all fingerprints as among all canonical texts
    by_row = {}
    for x in want:
        by_row.setdefault((x[0], x[1], x[2]), []).append(x)
    seen, back = {}, {}
    for g in got:
        w = by_row[g[0], g[1], g[2]][0]
        for fp, c in ((g[3], w[3]), (g[4], w[4])):
            assert seen.setdefault(fp, c) == c and back.setdefault(c, fp) == fp
    return got


def table(spark, rows):
    return spark.createDataFrame([(*r, b"k") for r in rows], "doc_id long, text string, rid binary")


def test_canonical_form(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", f.canonical(F.col("t")).alias("c"))
    for r in df.collect():
        assert r.c == canon(r.t), (r.t, r.c)


@pytest.mark.parametrize("weak", [False, True])
def test_against_brute_force(spark, monkeypatch, weak):
    if weak:  # forces different forms into one bucket
        monkeypatch.setattr(f, "digest", lambda c: F.concat(F.lit("h"), F.length(c) % 3))
    rows = list(enumerate(TEXTS)) + [(50 + i, "same text here") for i in range(9)] + [(70, None), (None, "x"), (None, "y"), (3, "again"), (3, "again"), (3, "again"), (90, "z" * 200_000), (91, "Q"), (92, "ab"), (93, "AB")]
    agree(table(spark, rows), rows)


def test_small_tables(spark):
    assert f.fingerprint(table(spark, [])).count() == 0
    agree(table(spark, [(1, "only one")]), [(1, "only one")])


def test_real(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    agree(docs, [(r.doc_id, r.text) for r in docs.collect()])
