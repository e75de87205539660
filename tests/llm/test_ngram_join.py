import itertools
import random

import numpy as np
import pytest

from seqloom.llm import ngram_join as g
from seqloom.llm.components import components


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if (rows[i][1] or "") == (rows[j][1] or "") or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
            links[i] += 1
            links[j] += 1
            parent[max(find(i), find(j))] = min(find(i), find(j))
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(find(i), []).append(i)
    out = []
    for members in classes.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], min(ids, default=None), len(members), links[i]) for i in members]
    return sorted(out, key=str)


def made(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 8)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((i, " ".join(t)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "  "), (i + 3, "a"), (i + 4, "a"), (i + 5, "A"), (None, "a"), (None, "only here now"), (3, rows[3][1]), (i + 6, "x y " * 30_000)]
    return rows


def test_pruning_table():
    least = g.least_matches(0.8, 1e-6)
    assert list(least) == [32, 64, 96, 128] and all(0 < m < n for n, m in least.items())
    assert g.least_matches(0.8, 0.5)[128] > least[128]


def test_estimate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    s = g.signatures(np.concatenate([a, b]), np.array([1000, 1000]))
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.15


def test_against_all_pairs(spark):
    rows = made()
    df = spark.createDataFrame([(a, b, b"x") for a, b in rows], "doc_id long, text string, key binary")
    got = sorted(((r.doc_id, r.class_id, r.class_size, r.n_links) for r in g.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_tiles_change_nothing(spark, monkeypatch):
    for name, value in (("TILE", 3), ("LEAST_TILE", 2), ("SPREAD", 2), ("TILE_BYTES", 3000)):
        monkeypatch.setattr(g, name, value)
    rows = made(8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.class_size, r.n_links) for r in g.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    kept = g.one_of_each(df).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted({r[1] for r in got}, key=str)


def test_real_and_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.class_id, r.class_size, r.n_links) for r in g.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)
    assert sorted(r.doc_id for r in g.one_of_each(docs).collect()) == sorted({r[1] for r in got})
    assert g.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (5, 4), (4, 4), (None, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    for a, b in edges:
        if a is not None and a != b:
            parent.setdefault(a, {a}), parent.setdefault(b, {b})
            merged = parent[a] | parent[b]
            for x in merged:
                parent[x] = merged
    assert got == {x: min(m) for x, m in parent.items()}


def test_words_decide_where_hashes_are_equal(spark, monkeypatch):
    """With every word's hash alike all texts of a length are candidates; only truly similar ones are linked."""
    monkeypatch.setattr(g, "WEIGHT", np.zeros(64, np.uint64))
    rows = made(9)[:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.class_size, r.n_links) for r in g.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_exact_grams():
    texts = ["a b c d e f", "A B C D E", "a b c", None, "", "b c d e f", "a b c d", "x " * 9, "a b c"]
    got = g.exact_grams(texts, 5)
    want = [shingles(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    for a, x in zip(got, want):
        for b, y in zip(got, want):
            assert len(np.intersect1d(a, b)) == len(x & y)


def test_blocks_of_rows_and_values():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30))) for _ in range(50)]
    assert (g.linked(sets, (4, 5)) == g.linked(sets, (4, 5), rows=7, width=5)).all()


def test_names_of_extra_columns(spark):
    names = "id _id key _key chosen row _text text_key class_key class_id".split()
    rows = [(i, "a b c d e f g h " * 4 + ("z" if i % 2 else ""), *[f"{n}{i}" for n in names]) for i in range(6)]
    out = g.one_of_each(spark.createDataFrame(rows, ["doc_id", "text", *names]))
    assert out.columns == ["doc_id", "text", *names] and [tuple(r) for r in out.collect()] == rows[:1]
