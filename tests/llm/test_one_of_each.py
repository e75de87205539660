"""One row left of each class, where ids are repeated or null."""

from seqloom.llm import ngram_join as g


def words(stem, changed=""):
    return " ".join([f"{stem}{i}" for i in range(60)] + ([changed] if changed else []))


def test_classes_with_equal_and_null_ids(spark):
    rows = [
        (1, words("a")), (1, words("b")), (2, words("a", "x")), (3, words("b", "y")),  # two classes, both of id 1
        (4, words("c")), (4, words("c", "z")),  # one class, one id, two texts
        (None, words("d")), (None, words("d", "u")), (None, words("d", "v")),  # near copies without ids
        (None, words("e")), (None, words("f")), (None, words("f", "w")), (9, words("f", "q")),
        (None, words("e")), (None, None), (None, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = {}
    for r in g.near_duplicates(docs).collect():
        classes.setdefault(bytes(r.class_key), []).append(r)
    assert sorted(len(m) for m in classes.values()) == [2, 2, 2, 2, 2, 3, 3]
    assert all(r.class_size == len(m) for m in classes.values() for r in m)
    kept = sorted((r.doc_id or 0, (r.text or "-")[0]) for r in g.one_of_each(docs).collect())
    assert kept == [(0, "-"), (0, "d"), (0, "e"), (1, "a"), (1, "b"), (4, "c"), (9, "f")]
