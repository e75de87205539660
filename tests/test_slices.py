import random

import pyarrow as pa

from seqloom.functions import bleu, slices
from seqloom.operators import corpus, subwords


def test_parts_of_a_batch_are_bounded_and_whole():
    rng = random.Random(3)
    lists = [None if rng.random() < 0.1 else ["w"] * rng.choice((0, 1, 5, 40)) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(lists, pa.list_(pa.string()))], names=["id", "words"])
    parts = list(slices.by_elements(batch, elements=100))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and len(parts) > 10
    assert all(sum(len(x or ()) for x in p.column(1).to_pylist()) < 140 for p in parts)
    assert list(slices.by_elements(batch.slice(0, 0)))[0].num_rows == 0


def test_rows_as_objects():
    lists = [["a", None], None, [], ["b", "c", "d"], ["e"]]
    column = pa.array(lists, pa.list_(pa.string()))
    assert slices.objects(column) == lists and slices.objects(column.slice(1, 3)) == lists[1:4] and slices.objects(column.slice(2, 0)) == []
    assert slices.objects(pa.array(["x", None])) == ["x", None] and slices.objects(pa.array([True, None])) == [True, None]
    kind = pa.struct([("n", pa.int64())])
    got = slices.row_by_row(lambda x: {"n": x}, kind, pa.array(range(1000)))
    assert got.to_pylist() == [{"n": i} for i in range(1000)] and len(slices.row_by_row(lambda x: {"n": x}, kind, pa.array([], pa.int64()))) == 0


def test_operators_work_on_parts(spark):
    """A batch of more words than one part holds; pieces of remembered words are one object each."""
    rows = [(i, None if i % 7 == 0 else [None if (i + j) % 11 == 0 else f"w{(i * j) % 5}" for j in range(i % 9 * 1200)]) for i in range(60)]
    assert sum(len(w or ()) for _, w in rows) > slices.ELEMENTS
    df = spark.createDataFrame(rows, "id int, words array<string>").coalesce(1)
    vocab = spark.createDataFrame([("<pad>", 0), ("<unk>", 1), ("w0", 2), ("w1", 3), ("w3", 4)], "token string, id int")
    pieces = spark.createDataFrame([("▁w", -1), ("0", -2), ("1", -2)], "piece string, score long")
    ids = corpus.token_ids(df, "id", df.words, vocab)
    whole = ids.orderBy("id").collect(), corpus.tokens_of(ids, "id", vocab).orderBy("id").collect(), subwords.cut_words(df, "id", df.words, pieces).orderBy("id").collect()
    known = {"w0": 2, "w1": 3, "w3": 4}
    assert [r.ids for r in whole[0]] == [[known.get(w, 1) for w in words or ()] for _, words in rows]
    named = {2: "w0", 3: "w1", 4: "w3", 1: "<unk>"}
    assert [r.tokens for r in whole[1]] == [[named[x] for x in r.ids] for r in whole[0]]
    assert [r.pieces for r in whole[2]] == [None if words is None else [p for w in words if w for p in ("▁w", w[1])] for _, words in rows]
    trie = subwords.Trie([("ab", -1), ("c", -1)])
    assert trie.cut("abcab")[0] is trie.cut("xab")[-1]


def test_counts_come_row_by_row(spark):
    pairs = [(i, ["a"] * (i % 4) if i % 5 else None, ["a", "b"] if i % 3 else None) for i in range(600)]
    df = spark.createDataFrame(pairs, "id int, r array<string>, h array<string>").coalesce(1)
    got = {r.id: tuple(r.c) for r in df.select("id", bleu.count_column(2)("r", "h").alias("c")).collect()}
    assert got == {i: bleu.counts(r or [], h or [], 2) for i, r, h in pairs}


def test_few_elements_of_long_rows_are_objects(monkeypatch):
    """rows of long lists are converted a few elements at a time, not 256 rows whatever their length."""
    made, objects = [], slices.objects
    monkeypatch.setattr(slices, "objects", lambda c: (made.append((len(c), len(c.flatten()))) if pa.types.is_list(c.type) else None) or objects(c))
    lists = [["w"] * 30_000 if i % 3 else None for i in range(60)] + [["w"]] * 600
    kind = pa.struct([("n", pa.int64()), ("i", pa.int64())])
    column = pa.array(lists, pa.list_(pa.string()))
    got = slices.row_by_row(lambda i, a, b: {"n": len(a or ()) + len(b or ()), "i": i}, kind, pa.array(range(660)), column, column)
    assert got.to_pylist() == [{"n": 2 * len(x or ()), "i": i} for i, x in enumerate(lists)]
    assert max(n for n, _ in made) <= slices.ROWS and max(n for _, n in made) < slices.ELEMENTS // 2 + 30_000


def test_lists_are_mapped_in_parts(spark):
    """a batch's lists are looked up few elements at a time; what a part holds doesn't grow with the rows of a batch."""
    longest = 2_000

    def converter():
        def convert(flat):
            if len(flat) >= slices.ELEMENTS + longest:
                raise ValueError(f"{len(flat)} elements at a time")
            return pa.array([1] * len(flat), pa.int32())

        return convert

    rows = spark.range(300, numPartitions=1).selectExpr("id", f"CASE WHEN id % 7 > 0 THEN array_repeat('w', CAST(id % 3 * {longest // 2} AS INT)) END AS words")
    got = corpus._mapped(rows, "id", rows.words, converter, "ids", "int").selectExpr("id", "size(ids) AS n").collect()
    assert {r.id: r.n for r in got} == {i: i % 3 * longest // 2 if i % 7 else 0 for i in range(300)} and sum(r.n for r in got) > slices.ELEMENTS
