import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import hnsw as h


def brute(rows, k, asks, kind=np.float32):
    """Every row against every other one."""
    ok = [(i, np.array(v, kind).astype(float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for at, (q, x) in enumerate(ok):
        if asks(q):
            near = sorted((-float(v @ x), i) for n, (i, v) in enumerate(ok) if n != at and len(v) == len(x))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def got(df, k=20, **options):
    out = {}
    for r in h.self_search(df, F.col("vec_id") % 20 == 0, k, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, have = brute(rows, 20, lambda i: i % 20 == 0), got(df)
    assert set(want) == set(have)
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in have[q]}) for q in want)
    assert hit / sum(map(len, want.values())) >= 0.95
    for q in have:
        exact = dict(want[q])
        for i, s in have[q]:
            assert i != q and (i not in exact or s == pytest.approx(exact[i], abs=1e-12))
        assert have[q] == sorted(have[q], key=lambda x: (-x[1], x[0]))


def test_unequal_lengths_of_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * rng.lognormal(0, 1)).astype(np.float32).tolist()) for i in range(1500)]
    want, have = brute(rows, 20, lambda i: i % 20 == 0), got(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=400)
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in have[q]}) for q in want)
    assert hit / sum(map(len, want.values())) >= 0.9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [0.5, 0.5]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (60, [1.0, 2.0, 3.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [-1.0, 0.0]), (9, [0.9, 0.1]), (9, [0.1, 0.9])]
    rows += [(100 + i, [0.25, 0.75]) for i in range(90)]  # one vector many times: ties go to smaller ids
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, row int")
    want, have = brute(rows, 20, lambda i: i % 20 == 0), got(df)
    assert {q: [i for i, _ in v] for q, v in want.items() if v} == {q: [i for i, _ in v] for q, v in have.items()}
    assert got(df.limit(0)) == {}


def test_scores_of_doubles(spark):
    """Vectors of double are searched, told apart and scored as they are."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(300, [x + 1e-12 for x in rows[0][1]]), (301, rows[0][1])]  # as floats these would be equal
    want, have = brute(rows, 20, lambda i: i % 20 == 0, float), got(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for q, found in want.items():
        assert [i for i, _ in have[q]] == [i for i, _ in found]
        assert [s for _, s in have[q]] == pytest.approx([s for _, s in found], abs=1e-15)
    whole = spark.createDataFrame([(i, [i % 7, 1 + i % 3]) for i in range(50)], "vec_id long, embedding array<int>")
    assert len(got(whole)) == 3
