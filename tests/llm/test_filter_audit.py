import random
import re
from itertools import permutations

import pyarrow as pa
import pytest

from seqloom.llm import filter_audit as f

BLANK = re.compile(rb"[^\x20\x09-\x0d]+")


def counts(text):
    raw = (text or "").encode()
    words = BLANK.findall(raw)
    return len(words), len(set(words)), len(re.findall(rb"[A-Z]", raw)), len(re.findall(rb"[#$%&*|]", raw)), len(text or "")


def random_texts():
    rng = random.Random(1)
    pieces = ["a", "B", "ab", "abcdefgh", "abcdefghi", "abcdefghj", "é", "漢字", "👩‍👩‍👧", "#", "$x", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", " ", "x" * 63, "x" * 64, "x" * 65, "x" * 200, "x" * 199 + "y"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(40))) for _ in range(500)]
    return [*texts, "", None, "word " * 100_000, "y" * 700_000 + " " + "y" * 700_000, *[""] * 100, " tail", "head "]


@pytest.mark.parametrize("base", [f.BASE, 1])
@pytest.mark.parametrize("size", [1 << 18, 50])
def test_counts(monkeypatch, base, size):
    """Base 1 gives equal hashes to all words with the same letters: bytes decide."""
    monkeypatch.setattr(f, "SLICE_BYTES", size)
    monkeypatch.setattr(f, "SLICE_ROWS", 37)
    texts = [*random_texts(), "ab ba ab ba abc cab", "abcdefghi bcdefghia"]
    got = list(zip(*(x.tolist() for x in f.counts_of(pa.array(texts), f.Scanner(base))), strict=True))
    assert got == [counts(t) for t in texts]
    part = pa.array(texts).slice(5, 30)
    assert list(zip(*(x.tolist() for x in f.counts_of(part, f.Scanner(base))), strict=True)) == [counts(t) for t in texts[5:35]]


def test_hashes_that_differ_below_the_sorted_bits(monkeypatch):
    """Interleaved low bits: equal words may not be neighbours, so the text is counted by a set."""
    monkeypatch.setattr(f.Scanner, "hashes", lambda self, data, start, stop: start.astype("u8") % 2)
    assert f.counts_of(pa.array(["ab ab cd ab cd"]), f.Scanner())[1].tolist() == [2]


def by_contract(docs, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    first = {}
    for d, _, t in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    rows = []
    for d, s, t in docs:
        words, distinct, capitals, symbols, chars = counts(t)
        fails = {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * capitals > 2 * chars, "D": symbols > 0, "E": d is not None and first[t or ""] < d}
        rows.append((s or "", d, {k for k, v in fails.items() if v}))
    out = {}
    for part in {r[0] for r in rows}:
        mine, each = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for o in map("".join, permutations("ABCDE")):
            left = list(mine)
            for k, x in enumerate(o):
                gone = [r for r in left if x in r[2]]
                left = [r for r in left if x not in r[2]]
                failing = [r for r in mine if x in r[2]]
                out[part, o, k + 1] = [len(left), len(gone), len([r for r in failing if r[2] & set(o[:k])]), len([r for r in mine if r[2] == {x}]), len([r for r in gone if r[1] in good]), len([r for r in gone if r[1] in toxic])]
                each[x] += len(gone)
        for o in map("".join, permutations("ABCDE")):
            for k, x in enumerate(o):
                out[part, o, k + 1].append(each[x])
    return out


def test_audit_by_contract(spark):
    rng = random.Random(2)
    texts = ["", None, "word " * 250, " ".join(map(str, range(250))), " ".join(f"W{k}" for k in range(300)), "a # b", "A", "same text", "x" * 100_000]
    docs = [(rng.choice([*range(60), None]), rng.choice(["s", "t", "", None]), rng.choice(texts)) for _ in range(300)]
    docs += [(7, "u", "same text")] * 5 + [(8, "u", "same text")] * 3 + [(None, "v", "same text")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 70, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, part int").withColumnRenamed("part", "fails")
    ldf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in f.audit(df, ldf).collect()}
    assert got == by_contract(docs, labels)
    none = {k: [*v[:4], 0, 0, v[6]] for k, v in got.items()}
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in f.audit(df, ldf.limit(0)).collect()} == none
    assert f.audit(df.limit(0), ldf).count() == 0


def test_scanned_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "A b", 2.5)], "`odd name` long, text string, y double")
    assert f.scanned(df, "text").collect()[0].asDict() == {"odd name": 1, "y": 2.5, "n_words": 2, "n_distinct": 2, "n_capitals": 1, "n_symbols": 0, "n_chars": 3}
