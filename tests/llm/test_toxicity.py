import numpy as np
import pytest

from seqloom.llm import toxicity as t


def test_scores_match_the_formula():
    rng = np.random.default_rng(0)
    m = t.Machine(6, 0.3, rng.normal(size=64).astype(np.float32), rng.normal(size=(64, 3)).astype(np.float32))
    rows = [np.array([], np.int32), np.array([3, 9, 40], np.int32), np.arange(20, dtype=np.int32)]
    got = t.raw_scores(m, np.concatenate(rows), np.cumsum([len(r) for r in rows]))
    for r, x in zip(rows, got, strict=True):
        pairs = sum(float(m.factors[i] @ m.factors[j]) for a, i in enumerate(r) for j in r[a + 1 :])
        assert x == pytest.approx(0.3 + float(m.weights[r].sum()) + pairs, rel=1e-5)


def test_learns_an_interaction():
    """Neither word alone is toxic; both together are."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)
    rows = [np.array(sorted({1, *([2] if x else [3]), *([4] if y else [5])}), np.int32) for x, y in zip(a, b, strict=True)]
    y = ((a == 1) & (b == 1)).astype(float)
    m = t.fit(rows, y, bits=4, epochs=40)
    s = t.sigmoid(t.raw_scores(m, np.concatenate(rows), np.cumsum([len(r) for r in rows])))
    assert ((s >= 0.5) == (y == 1)).mean() > 0.99


def test_pairs_that_linear_weights_miss():
    """An insult is toxic beside the group it is meant for and clean beside any other: no sum of weights tells them apart."""
    rng = np.random.default_rng(4)
    rows, y = [], []
    for _ in range(4000):
        kind, i = rng.choice(3, p=[0.4, 0.3, 0.3]), rng.integers(0, 4)
        group = i if kind == 1 else (i + rng.integers(1, 4)) % 4
        said = [1 + i, 11 + group] if kind else []
        rows.append(np.unique([*said, *rng.choice(range(30, 60), 5)]).astype(np.int32))
        y.append(float(kind == 1))
    y = np.array(y)
    held = np.arange(4000) % 4 == 0
    m = t.fit([r for r, h in zip(rows, held) if not h], y[~held], bits=6)
    score = t.raw_scores(m, np.concatenate(rows), np.cumsum([len(r) for r in rows]))
    x = np.zeros((4000, 64))
    for k, r in enumerate(rows):
        x[k, r] = 1
    w, bias = np.zeros(64), 0.0
    for _ in range(3000):  # logistic regression, the best that additive weights can do
        error = t.sigmoid(x[~held] @ w + bias) - y[~held]
        w, bias = w - x[~held].T @ error / 300, bias - error.mean()
    linear = ((x[held] @ w + bias > 0) == (y[held] == 1)).mean()
    assert ((score[held] > 0) == (y[held] == 1)).mean() > 0.95 > 0.8 > linear


def test_a_pure_pair():
    """Either word is toxic without the other and clean with it: neither means anything by itself."""
    rng = np.random.default_rng(3)
    rows, y = [], []
    for _ in range(6000):
        a, b = rng.integers(0, 2), rng.integers(0, 2)
        rows.append(np.unique([1 + a, 3 + b, *rng.choice(range(10, 3000), 40)]).astype(np.int32))
        y.append(float(a != b))
    y, held = np.array(y), np.arange(6000) % 4 == 0
    m = t.fit([r for r, h in zip(rows, held) if not h], y[~held], bits=12)
    score = t.raw_scores(m, np.concatenate(rows), np.cumsum([len(r) for r in rows]))
    assert ((score[held] > 0) == (y[held] == 1)).mean() > 0.95


def test_pairs_by_definition():
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 1100, 500)).astype(np.int32) for _ in range(150)]
    error, variance = rng.normal(0, 1, 150), rng.random(150)
    error[:20] = 0.01  # clear ones take no part
    error[[k for k, r in enumerate(rows) if 5 in r and 900 in r]] += 3
    z = np.zeros((1100, 1100))
    x = np.zeros((150, 1100))
    for k, r in enumerate(rows):
        x[k, r] = abs(error[k]) >= t.CLEAR
    z = np.abs((x * error[:, None]).T @ x) / np.sqrt(np.maximum((x * variance[:, None]).T @ x, 1))
    np.fill_diagonal(z, 0)
    z[x.sum(0) < 16], z[:, x.sum(0) < 16] = 0, 0
    got = t.pair_values(rows, error, variance, 1100, 4.0)
    assert got == pytest.approx(np.clip((z.max(1) - 4) / 8, 0, 1), abs=1e-4) and got[5] > 0


def test_one_text_an_id(spark, monkeypatch):
    """An id repeated any number of times is one row of the sample."""
    learnt = []
    monkeypatch.setattr(t, "fit", lambda rows, labels, **_: learnt.append((len(rows), int(labels.sum()))) or t.Machine(4, 0.0, np.zeros(16, np.float32), np.zeros((16, 1), np.float32)))
    docs = spark.range(30_000).selectExpr("IF(id < 20000, 2L, id % 40) AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(40).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    t.train(docs, labels, bits=4, per_class=5)
    assert learnt == [(10, 5)]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    scored = t.score(docs, t.train(docs, labels)).withColumn("held_out", t.held_out()).join(labels, "doc_id").where("held_out").collect()
    true = sum(r.toxic == 1 and r.predicted == 1 for r in scored)
    assert true / sum(r.toxic for r in scored) > 0.8
    assert true / max(1, sum(r.predicted for r in scored)) > 0.95


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "idiot fool"), (2, None), (3, ""), (None, "idiot"), (1, "idiot fool"), (4, "word " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    m = t.train(docs, labels)
    rows = t.score(docs, m).collect()
    assert len(rows) == 6 and all(r.score == 0 and r.predicted == 0 for r in rows)
    assert t.score(docs.limit(0), m).count() == 0


def test_lists_are_parts_of_one_array():
    """The driver holds a sample's terms as numbers, not as an object each."""
    import pyarrow as pa

    kind = pa.list_(pa.int32())
    lists = pa.chunked_array([pa.array([[3, 1], []], kind), pa.array([[], [7]], kind)])
    got = t.arrays_of(lists)
    assert [x.tolist() for x in got] == lists.to_pylist() and len({id(x.base) for x in got}) == 1 and got[0].dtype == np.int32
    assert t.arrays_of(pa.chunked_array([pa.array([], kind)])) == []
