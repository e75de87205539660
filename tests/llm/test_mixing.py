import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import mixing as m

SIZE = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Shares by weight; what is above a cap goes to the others until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest, wide = total - sum(fixed.values()), sum(w[s] for s in free)
        out = fixed | {s: rest * w[s] / wide for s in free}
        over = [s for s in free if out[s] > most * sizes[s] + 1e-9]
        if not over:
            return out
        fixed |= {s: most * sizes[s] for s in over}


def checked(df):
    rows = m.plan(df, block_docs=8, shards=5).collect()
    again = m.plan(df, block_docs=8, shards=5).collect()
    key = lambda r: (str(r.row.doc_id), r.taken, str(r.row.source), str(r.draws))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    sizes, taken = {}, {}
    for r in rows:
        assert r.size == len(SIZE.findall(r.row.text or ""))
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(d.words for d in r.draws)
        sizes[r.row.source] = sizes.get(r.row.source, 0) + r.size
        taken[r.row.source] = taken.get(r.row.source, 0) + r.taken
    if rows:
        want = brute_targets(sizes)
        for r in rows:
            assert r.source_size == sizes[r.row.source] and r.target == pytest.approx(want[r.row.source])
        for s, x in want.items():
            assert abs(taken[s] - x) <= 0.5001
    return rows


def test_tree():
    q = [1000, 10, 0, 333]
    t = m.splitting_tree(q, 7, 1)
    assert t.sum(0).tolist() == q and t.sum(1).max() - t.sum(1).min() <= 2
    draws = np.array([m.splitting_tree([60, 40], 2, s)[0, 0] for s in range(400)])
    assert abs(draws.mean() - 30) < 0.5 and abs(draws.var() - 50 * 0.6 * 0.4 * 50 / 99) < 1.5


def test_plan(spark):
    rows = [(i, f"s{i % 4}", "w " * (i % 37)) for i in range(300)] + [(1000 + i, None, "a b\x0bc　d") for i in range(20)] + [(7, "zz", None), (None, "s0", "x y"), (5, "s1", "w " * 5), (5, "s1", "w " * 5), (6, "é", "one"), (6, "z", "long " * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, _size int")
    assert len(checked(df)) == len(rows)
    assert checked(df.limit(0)) == []
    assert checked(df.where("text IS NULL")) and m.mix(df.where("text IS NULL")).count() == 0


def test_many_sources(spark, monkeypatch):
    """Beyond a bound only hot sources are sent to all rows; the plan is the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(str, m.plan(docs, ["doc_id"]).collect()))
    monkeypatch.setattr(m, "SENT_SOURCES", 0)
    assert sorted(map(str, m.plan(docs, ["doc_id"]).collect())) == want


def test_real(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = checked(docs)
    want = {r.row.doc_id: sorted(r.size for d in r.draws if 2 * d.words >= r.size) for r in rows}
    mixed = m.mix(docs, shards=5, block_docs=8)
    assert mixed.columns == docs.columns
    got = {}
    for r in mixed.select("doc_id", m.size_of(F.col("text")).alias("n"), (F.length("text") == F.col("n_chars")).alias("ok")).collect():
        assert r.ok
        got.setdefault(r.doc_id, []).append(r.n)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_blocks_are_drawn_as_the_tree_says(spark):
    """Whole blocks by hand: which blocks a quota takes, how many each shard gets, and that shards share none of them."""
    rows = [(i, f"s{i % 3}", "w " * (1 + i % 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = m.plan(df, ["doc_id", "source"], block_docs=10, shards=4, seed=23).collect()
    n_blocks = {f"s{k}": -(-200 // 10) for k in range(3)}
    blocks, drawn = {}, {}
    for r in plan:
        b = r.row.source, r.u % n_blocks[r.row.source]
        blocks.setdefault(b, []).append(r)
        for d in r.draws:
            drawn.setdefault((*b, d.copy), set()).add(d.shard)
    assert all(len(shards) == 1 for shards in drawn.values())  # a drawn block goes to one shard whole
    quota = []
    for s in sorted(n_blocks):
        target, total = round(blocks[s, 0][0].target), blocks[s, 0][0].source_size
        passes, rest = divmod(target, total)
        start = n = 0
        for b in range(n_blocks[s]):
            mine = sorted(blocks.get((s, b), []), key=lambda r: r.u)
            n += (passes + (start < rest)) * bool(mine)
            for r in mine:
                want = passes * r.size + max(0, min(r.size, rest - start))
                assert r.taken == want
                start += r.size
        quota.append(n)
    tree = m.splitting_tree(quota, 4, 23)
    for i, s in enumerate(sorted(n_blocks)):
        got = np.bincount([next(iter(v)) for (source, _, _), v in drawn.items() if source == s], minlength=4)
        assert got.tolist() == tree[:, i].tolist()


def test_names_of_extra_columns(spark):
    names = "row size u source_key _source_key block _block start _start rest _rest passes _passes places _places source_size _source_size target _target taken _taken draws _draws d _d copy shard words n _n said before _before n_blocks source_TEXT k c".split()
    df = spark.createDataFrame([(i, f"s{i % 3}", "w " * (i % 7), *[f"{c} {i}" for c in names]) for i in range(60)], ["doc_id", "source", "text", *names])
    out = m.mix(df, block_docs=8, shards=3)
    assert out.columns == df.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c} {r.doc_id}" for r in rows for c in names)
