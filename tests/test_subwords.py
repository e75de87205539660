import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from seqloom.operators import subwords


def all_cuts(word):
    for n in range(len(word)):
        for at in combinations(range(1, len(word)), n):
            bounds = [0, *at, len(word)]
            yield [word[a:b] for a, b in zip(bounds, bounds[1:])]


def test_cuts_by_trying_all():
    rng = random.Random(1)
    ties = 0
    for _ in range(300):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -rng.randint(1, 6) for _ in range(12)}
        trie = subwords.Trie(pieces.items())
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 8)))
        score = lambda cut: sum(pieces.get(p, trie.unknown if len(p) == 1 else -math.inf) for p in cut)  # noqa: B023, E731
        cuts = list(all_cuts(word))
        top = max(map(score, cuts))
        best = [c for c in cuts if score(c) == top]
        ties += len(best) > 1
        # of equal ones the longest last piece, then the longest before it
        assert trie.cut(word) == max(best, key=lambda c: [len(p) for p in c[::-1]])
    assert ties > 5 and subwords.Trie([]).cut("ab") == ["a", "b"] and subwords.Trie([("a", -1)]).cut("") == []


def test_vocabulary_and_columns(spark):
    counts = spark.createDataFrame([("aa", 5), ("ab", 2), (None, 9)], "word string, count long")
    vocab = {r.piece: r.score for r in subwords.piece_vocabulary(counts, 2).collect()}
    n = {"▁": 7, "a": 12, "b": 2, "▁aa": 5, "▁a": 7}
    assert vocab == {k: round(math.log(v / 33) * 1e6) for k, v in n.items()}
    df = spark.createDataFrame([(1, ["aa", "ab", None, ""]), (2, []), (3, None), (4, ["x" * 5000])], "i long, i_words array<string>")
    got = {r.i: r.pieces for r in subwords.cut_words(df, "i", F.col("i_words"), subwords.piece_vocabulary(counts, 2)).collect()}
    assert got == {1: ["▁aa", "▁a", "b"], 2: [], 3: None, 4: ["▁", *"x" * 5000]}
    assert subwords.cut_words(df.limit(0), "i", F.col("i_words"), subwords.piece_vocabulary(counts, 2)).count() == 0


def test_limits(spark, monkeypatch):
    monkeypatch.setattr(subwords, "VOCABULARY_ROWS", 1)
    vocab = spark.createDataFrame([("a", -1), ("b", -1)], "piece string, score long")
    with pytest.raises(ValueError):
        subwords.cut_words(spark.range(1).select("id", F.array(F.lit("a")).alias("w")), "id", F.col("w"), vocab)
