import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from seqloom.operators import overlap
from seqloom.operators.neighbours import Index


@pytest.mark.parametrize("size", [(1, 1), (7, 2), (50, 64), (16_384, 64)])
def test_by_definition(spark, size):
    """Runs and blocks of any size, texts that are starts of each other, and code points above the first plane."""
    rng = random.Random(size[0])
    text = lambda: "".join(rng.choice("ab\x00é漢\U0001f600￿ ") for _ in range(rng.randrange(5)))
    train, test = [text() for _ in range(200)], [(rng.choice([None, str(k)]), text(), "x") for k in range(150)] + [("n", None, "x")]
    index = Index.of(spark.createDataFrame([(t,) for t in [*train, None]], "t string"), "t", *size)
    df = spark.createDataFrame(test, "i string, t string, _run string")
    got = sorted(map(tuple, index.neighbours(df, "t", "i").collect()), key=str)
    order = sorted(set(train), key=lambda x: x.encode())
    keys = [x.encode() for x in order]
    want = []
    for i, t, _ in test:
        if t is not None:
            at = bisect_right(keys, t.encode())
            want.append((i, t, order[at - 1] if at else None, order[at] if at < len(order) else None))
    assert got == sorted(want, key=str)


def test_null_ids_and_other_sides(spark):
    train = spark.createDataFrame([("a",), ("d",), ("g",), ("g",)], "t string")
    test = spark.createDataFrame([(1, "b"), (2, "e"), (None, "c"), (4, ""), (5, "z"), (6, "d")], "i int, t string")
    got = {r.text: (r.i, r.left_text, r.right_text) for r in overlap.neighbours(train, test, "t", "i").collect()}
    assert got == {"b": (1, "a", "d"), "e": (2, "d", "g"), "c": (None, "a", "d"), "": (4, None, "a"), "z": (5, "g", None), "d": (6, "d", "g")}
    assert overlap.neighbours(train, test, "t", "i").schema["i"].dataType.simpleString() == "int"
    none = overlap.neighbours(train.limit(0), test, "t", "i").collect()
    assert len(none) == 6 and all(r.left_text is r.right_text is None for r in none)
    assert overlap.neighbours(train, test.limit(0), "t", "i").count() == 0


def test_long_texts_have_short_fences(spark):
    train = spark.range(2000).select(F.concat(F.hex(F.xxhash64("id")), F.repeat(F.lit(" word"), 2000)).alias("t"))
    index = Index.of(train, "t", 500, 50)
    assert len(index.runs) == 4 and max(len(f) for f, _ in index.runs) < 8
    assert max(len(f) for r in index.fences.collect() for f in r.fences) < 16
