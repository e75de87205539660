import itertools
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import text
from seqloom.operators import batching, compare, corpus, feeding, overlap
from seqloom.plans import evaluation_queries
from tests.test_sequences import common


def test_first_of_each_and_counts(spark):
    rows = [(i, random.Random(i).choice("abc")) for i in range(50)] + [(60, None), (61, None)]
    df = spark.createDataFrame(rows, "i long, k string")
    first = {}
    for i, k in rows:
        first.setdefault(k, i)
    assert sorted(r.i for r in corpus.first_of_each(df, "k", "i").collect()) == sorted(first.values())
    assert corpus.dedup_counts(df, "k").first()[:] == (4, 48)
    # Repeated rows, orders that are null, equal or shared between keys, and names that would clash.
    rows = [("a", None, 1), ("b", 1, 1), ("b", 1, 1), ("c", None, 3), ("c", 1, 4), ("d", 1, 5), ("d", 1, 6), (None, 2, 7), (None, 9, 8)]
    df = spark.createDataFrame(rows, "k string, i long, _kept int")
    got = sorted(map(tuple, corpus.first_of_each(df, "k", "i").collect()), key=str)
    assert [r for r in got if r[0] != "d"] == sorted([("a", None, 1), ("b", 1, 1), ("c", 1, 4), (None, 2, 7)], key=str) and len(got) == 5
    assert got == sorted(map(tuple, corpus.first_of_each(df.repartition(3), "k", "i").collect()), key=str)
    assert corpus.first_of_each(df.select("k"), "k", "k").count() == 5 and corpus.first_of_each(df.limit(0), "k", "i").count() == 0


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit("x").alias("same"))
    got = sorted((r.idx, r.v) for r in corpus.dense_index(df, [F.col("same"), F.col("v")]).collect())
    assert got == [(i, i) for i in range(1000)]


def test_grouped_index(spark):
    rows = [(i, None if i % 7 == 0 else f"g{i % 3}") for i in range(200)]
    out = corpus.grouped_index(spark.createDataFrame(rows, "i long, g string"), "g", [F.col("i")], 5).collect()
    seen = {}
    for i, g in rows:
        seen.setdefault(g, []).append(i)
    assert sorted((r.i, r.position, r.group_size) for r in out) == sorted((i, k, len(m)) for m in seen.values() for k, i in enumerate(m))


def test_groups():
    sizes = [(f"g{i}", 10 + i) for i in range(30)]
    chosen = corpus.sample_groups(sizes, 120)
    assert 0.8 * 120 <= sum(dict(sizes)[g] for g in chosen) <= 1.1 * 120 and len(set(chosen)) == len(chosen)
    assert chosen == corpus.sample_groups(sizes, 120) != corpus.sample_groups(sizes, 120, seed=1)
    with pytest.raises(ValueError):
        corpus.sample_groups([("a", 1000)], 10, tries=50)
    some = corpus.sample_sets(sizes, 100)
    assert sum(dict(sizes)[g] for g in some) <= 100 and len(set(some)) == len(some)


def test_split(spark):
    df = spark.createDataFrame([(i, f"g{i % 5}") for i in range(100)], "i long, g string")
    out = corpus.with_training(df, "i", corpus.split_held_out(df, "i", "g", ["g1", "g2"], "dev", 2 / 3, 1)).collect()
    assert sorted(r.i for r in out) == list(range(100))
    assert {(r.split, r.i % 5) for r in out} == {("train", 0), ("train", 3), ("train", 4), ("dev", 1), ("dev", 2), ("train_extra", 1), ("train_extra", 2)}
    assert sum(r.split == "train_extra" for r in out) == 26


@pytest.mark.parametrize("hot", [4096, 1])
def test_difficulty(spark, monkeypatch, hot):
    monkeypatch.setattr(corpus, "HOT_WORDS", hot)
    df = spark.createDataFrame([(0, ["a", "a", "b", "zz"]), (1, []), (2, None)], "i long, w array<string>")
    counts = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "word string, count long")
    scores = {r.word: r.surprisal for r in corpus.surprisal(counts).collect()}
    assert scores == pytest.approx({"a": 0.693147181, "b": 1.098612289, "c": 1.791759469})
    got = {r.i: r.score for r in corpus.difficulty(df, "i", F.col("w"), corpus.surprisal(counts)).collect()}
    assert got == pytest.approx({0: 2 * scores["a"] + scores["b"], 1: 0, 2: 0})
    assert [r.i for r in corpus.prefix(corpus.difficulty(df, "i", F.col("w"), corpus.surprisal(counts)), "i", 2).collect()] == [1, 2]


def test_canonical(spark):
    texts = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x"), (3, "z")], "pos long, k string")
    canon = spark.createDataFrame([(0, "z", "old"), (1, "x", "cx"), (2, "z", "cz"), (3, "q", "cq")], "c long, k string, v string")
    joined = {r.k: (r.v, r.text_order) for r in corpus.canonical_join(texts, canon, "k", "pos", "c").collect()}
    assert joined == {"x": ("cx", 0), "z": ("cz", 3), "q": ("cq", None)}
    assert sorted(r.pos for r in corpus.canonical_unmatched(texts, canon, "k", "pos").collect()) == [1, 2]


def test_vocabulary(spark):
    counts = spark.createDataFrame([("b", 5), ("a", 5), ("c", 1), ("<unk>", 99)], "word string, count long")
    vocab = corpus.vocabulary(counts, 6)
    assert {r.token: r.id for r in vocab.collect()} == {"<pad>": 0, "<unk>": 1, "<s>": 2, "</s>": 3, "a": 4, "b": 5}
    df = spark.createDataFrame([(0, ["b", "c", "a", "b"]), (1, [])], "i long, w array<string>")
    ids = corpus.token_ids(df, "i", F.col("w"), vocab)
    assert {r.i: r.ids for r in ids.collect()} == {0: [5, 1, 4, 5], 1: []}
    assert {r.i: r.tokens for r in corpus.tokens_of(ids, "i", vocab).collect()} == {0: ["b", "<unk>", "a", "b"], 1: []}
    with pytest.raises(Exception):
        corpus.tokens_of(spark.sql("SELECT 0L AS i, array(77) AS ids"), "i", vocab).collect()
    with pytest.raises(ValueError):
        corpus.vocabulary(counts, 6, ("<a>", "<a>"))


def test_vocabularies_of_any_size(spark, monkeypatch):
    """Beyond a bound the vocabulary is joined: the same ids."""
    vocab = corpus.vocabulary(spark.createDataFrame([("b", 5), ("a", 5)], "word string, count long"), 6)
    df = spark.createDataFrame([(0, ["b", "c", "a", "b"], 1), (1, [], 2), (2, None, 3), (0, ["a", None], 4)] + [(k, ["b"] * 50, 5) for k in range(10, 20)], "i long, w array<string>, _row int")
    want = sorted(map(str, corpus.token_ids(df, "i", F.col("w"), vocab).collect()))
    monkeypatch.setattr(corpus, "VOCABULARY_ROWS", 3)
    ids = corpus.token_ids(df.where("i <> 0 OR _row = 1"), "i", F.col("w"), vocab)
    assert {r.i: r.tokens for r in corpus.tokens_of(ids, "i", vocab).collect()} == {0: ["b", "<unk>", "a", "b"], 1: [], 2: [], **{k: ["b"] * 50 for k in range(10, 20)}}
    with pytest.raises(Exception):
        corpus.tokens_of(spark.sql("SELECT 0L AS i, array(77) AS ids"), "i", vocab).collect()
    assert sorted(map(str, corpus.token_ids(df, "i", F.col("w"), vocab).collect())) == want


def test_sampling(spark):
    df = spark.range(500)
    got = [r.id for r in corpus.reservoir(df, 20, 1, "id").collect()]
    assert len(set(got)) == 20 and got == [r.id for r in corpus.reservoir(df.repartition(7), 20, 1, "id").collect()]
    assert corpus.reservoir(df, 1000, 1, "id").count() == 500
    assert sorted(r.id for r in corpus.shuffled(df, 5, "id").collect()) == list(range(500)) != [r.id for r in corpus.shuffled(df, 5, "id").collect()]


def test_overlap(spark):
    train = spark.createDataFrame([("a b c",), ("x y z",)], "t string")
    test = spark.createDataFrame([(7, "a b d")], "i long, t string")
    found = overlap.neighbours(train, test, "t", "i")
    assert found.first()[:] == (7, "a b d", "a b c", "x y z")
    assert overlap.scores(found, "i", text.words).first().overlap == pytest.approx(2 / 3)
    assert overlap.scores(overlap.neighbours(train.limit(0), test, "t", "i"), "i", text.words).first().overlap is None
    rng = random.Random(4)
    texts = lambda n: [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(n)]
    a, b = texts(60), texts(40)
    found = overlap.neighbours(spark.createDataFrame([(x,) for x in a], "t string"), spark.createDataFrame(list(enumerate(b)), "i long, t string"), "t", "i")
    got = {r.i: r.overlap for r in overlap.scores(found, "i", text.words).collect()}
    for i, x in enumerate(b):
        left, right = max((y for y in a if y <= x), default=None), min((y for y in a if y > x), default=None)
        ratios = [common(x.split(), y.split()) / max(len(x.split()), len(y.split())) for y in (left, right) if y is not None]
        assert got[i] == pytest.approx(max(ratios))
    scored = overlap.scores(found, "i", text.words)
    assert overlap.flagged(scored).count() == sum(v > 0.8 for v in got.values())
    assert sum(r.n for r in overlap.histogram(scored).collect()) == 40


def test_batches(spark):
    rng = random.Random(2)
    rows = [(i, f"s{i % 3}", rng.randint(1, 30), rng.randint(1, 30)) for i in range(200)] + [(900, "s0", 500, 1)]
    out = batching.budget_batches(spark.createDataFrame(rows, "i long, s string, a int, b int"), "s", "i", "a", "b", 100).collect()
    assert len(out) == len(rows)
    key = lambda r: (r.s, r.batch_no)
    for _, group in itertools.groupby(sorted(out, key=lambda r: (r.s, r.batch_no, r.i)), key=key):
        group = list(group)
        assert len(group) * max(max(r.a, r.b) for r in group) <= 100 or len(group) == 1
    for s in ("s0", "s1", "s2"):
        numbers = [r.batch_no for r in sorted(out, key=lambda r: r.i) if r.s == s]
        assert numbers == sorted(numbers) and set(numbers) == set(range(max(numbers) + 1))


def test_process_and_collate(spark):
    import public_tokenizers

    row = spark.sql("SELECT split('v1 = x', ' ') AS src_tokens, split('a b', ' ') AS tgt_tokens, map('v1', named_struct('decomp', 'd', 'orig', 'o')) AS n")
    vocab = {"d": 10, "=": 11, "a": 12}
    out = feeding.process(row, vocab=vocab, end_id=3, names="n").first()
    assert (out.src_ids, out.tgt_ids) == ([10, 11, 1, 3], [12, 1, 3])
    cut = feeding.process(row, vocab=vocab, end_id=3, mode="truncate", max_src=3, max_tgt=2).first()
    assert (cut.src_ids, cut.tgt_ids) == ([1, 11, 3], [12, 3])
    with pytest.raises(ValueError):
        feeding.length_mode(row, "src_tokens", "tgt_tokens", "other")
    batch = spark.sql("SELECT 1 AS batch_id, array(5, 3) AS src_ids, array(6, 7, 3) AS tgt_ids UNION ALL SELECT 1, array(5, 5, 3), array(3) UNION ALL SELECT 1, NULL, NULL")
    got = sorted(feeding.collate(batch, start_id=2, end_id=3).collect(), key=lambda r: r.source_length)
    assert [(r.source, r.target_output, r.target_input) for r in got] == [([5, 3, 3], [6, 7, 3], [2, 6, 7]), ([5, 5, 3], [3, 3, 3], [2, 3, 3])]
    pieces = row.select(feeding.encode_subwords(F.col("tgt_tokens"), public_tokenizers.path("piece_bpe_32k.model")).alias("p")).first().p
    assert "".join(pieces).replace("▁", "") == "ab"


def test_compare(spark):
    rows = [(i, s, float(v), w) for i, (v, w) in enumerate([(1, 5), (2, 2), (3, 3), (2, 9)]) for s, v, w in (("a", v, w), ("b", 2, 3))]
    df = spark.createDataFrame(rows, "idx long, system string, bleu4 double, arg_redundant long")
    got = compare.better_on_all(df, "idx", "a", "b", ["bleu4"]).orderBy("ordinal").collect()
    assert [(r.idx, r.ordinal) for r in got] == [(2, 0)]
    assert [r.idx for r in compare.better_on_all(df, "idx", "a", "b", []).orderBy("ordinal").collect()] == [0, 1, 2, 3]
    lower = compare.better_on_all(df, "idx", "a", "b", ["arg_redundant"]).collect()
    assert [r.idx for r in lower] == [1]  # fewer redundant arguments are better, equal values are out
    ranked = compare.better_on_all(df, "idx", "b", "a", ["arg_redundant"])
    assert [r.idx for r in ranked.orderBy("ordinal").collect()] == [3, 0]
    assert [(r.idx, r.place) for r in compare.page(ranked, 1, 1).collect()] == [(0, 0)]
    assert compare.shown_pages(0, 3) == [0, 1, 2] and compare.shown_pages(9, 30) == list(range(5, 14))
    assert [r.idx for r in compare.gather(df.where("system = 'a'"), "idx", [3, 1, 3]).orderBy("ordinal").collect()] == [3, 1, 3]
    with pytest.raises(ValueError):
        compare.better_on_all(df, "idx", "a", "a", [])
    systems = spark.sql("SELECT * FROM VALUES (0, array('x')), (1, array('y', 'x')) AS t(ordinal, tags)")
    assert compare.with_any_tag(systems, ["y"]).count() == 1 and evaluation_queries.tag_index(spark, "").count() == 3
