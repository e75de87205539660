import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from seqloom.llm import queries, runs

SF = "/root/testdata/sf0.01"


def by_definition(words, least_words=24, least_periods=3):
    """Every stretch that repeats at a distance, tried for each distance from the smallest on."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= 2 * q and not any(q % p == 0 and s <= start and start + length <= s + m for (s, m), p in out.items()):
                out.setdefault((start, length), q)
            i = j
    return sorted((s, q, m) for (s, m), q in out.items() if m >= least_words and m >= least_periods * q)


def as_tuples(found):
    return [(r.start, r.period, r.length) for r in found]


@pytest.mark.parametrize("periods", [2, 3, 5])
@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_all_runs_of_random_words(letters, periods):
    rng = random.Random(letters * 10 + periods)
    for _ in range(300):
        words = [rng.randrange(letters) for _ in range(rng.randrange(60))]
        if rng.random() < 0.7 and words:
            a, p = rng.randrange(len(words)), rng.randrange(1, 12)
            words[a:] = (words[a : a + p] * 60)[: rng.randrange(60)]
        for least in (2, 24):
            assert as_tuples(runs.runs(words, least, periods)) == by_definition(words, least, periods), words


def test_runs_inside_runs():
    """Runs of short periods repeat inside runs of long ones."""
    inner = list("abababcc") * 3 + ["x"]
    words = [*"pq", *inner, *inner, *inner, *inner[:5], *"r"]
    assert as_tuples(runs.runs(words, 4, 2)) == by_definition(words, 4, 2)
    words = [w for k in range(14) for w in (list("ab") if k in (1, 2, 4, 7, 12) else list("a"))] * 4
    assert as_tuples(runs.runs(words, 2, 2)) == by_definition(words, 2, 2)


def test_no_hash_decides_alone(monkeypatch):
    """With a base of 0 all hashes but the first word's are blind: results stay right."""
    real = runs.Extensions.__init__

    def blind(self, codes, base=0):
        real(self, codes, 0)
        self.sums[:] = 0
        self._sums = [0] * (self.n + 1)

    monkeypatch.setattr(runs.Extensions, "__init__", blind)
    rng = random.Random(3)
    for _ in range(100):
        words = [rng.randrange(3) for _ in range(40)]
        words[10:] = (words[10:14] * 20)[: rng.randrange(30)]
        assert as_tuples(runs.runs(words, 4, 3)) == by_definition(words, 4, 3)


def test_lyndon_words_by_definition():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
        got = runs.longest_lyndon(words, runs.Extensions(np.array(words)))
        for i, j in enumerate(got):
            smaller = [k for k in range(i + 1, len(words)) if words[k:] < words[i:]]
            assert j == (smaller[0] if smaller else len(words))


def test_the_screen_passes_every_document_with_a_run():
    rng = random.Random(6)
    for _ in range(500):
        n = rng.randrange(24, 80)
        p = rng.randrange(1, n // 3 + 1)
        words = [rng.randrange(1000) for _ in range(rng.randrange(20))] + [*(list(rng.choices(range(1000), k=p)) * n)[:n]]
        assert runs.repeated(words) and runs.document_runs(words) == runs.runs(words)
    assert not runs.repeated(list(range(5000))) and not runs.repeated([]) and not runs.repeated([1] * 8)


def test_long_repetitions_take_linear_time():
    for words in (["a"] * 150_000, ["a", "b", "a"] * 50_000, [str(k % 40_000) for k in range(150_000)], list(map(str, range(150_000)))):
        began = time.perf_counter()
        found = runs.runs(words)
        assert time.perf_counter() - began < 30
        assert len(found) == (words[0] != "0" or words[40_000] == "0")


def test_dropped_words():
    words = list("xy") + list("abc") * 9 + list("z")
    (r,) = runs.runs(words)
    assert (r.start, r.period, r.length) == (2, 3, 27) and runs.collapsed(words, [r]) == list("xyabcz")
    assert runs.collapsed([1, 2], []) == [1, 2] and runs.best([]) is None
    a, b, c = runs.Run(5, 4, 24), runs.Run(9, 5, 30), runs.Run(9, 4, 24)
    assert runs.best([a, c, b]) == a and runs.best([runs.Run(0, 10, 59), a]) == a


def planted_by_contract(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text, length=600):
    words = planted_by_contract([w for w in (text or "").encode().replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\t", b" ").replace(b"\r", b" ").replace(b"\n", b" ").split(b" ") if w], doc_id)
    found = by_definition(words)
    drop = {k for s, q, m in found for k in range(s + q, s + m)}
    top = min(found, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, q, m in found)
    kept = b" ".join(w for k, w in enumerate(words) if k not in drop)
    figures = (top[0], top[2], top[1], 1000 * top[2] // top[1]) if top else (None,) * 4
    return (doc_id, len(found), *figures, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_by_definition(spark):
    """The registered query on whole texts; the brute force takes the square of a text's words, so it goes to the shorter ones."""
    got = {r.doc_id: tuple(r) for r in queries.op13_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    tried = [d for d in docs if len((d.text or "").split()) <= 700]
    assert len(tried) > 700
    for d in tried:
        assert got[d.doc_id] == expected(d.doc_id, d.text)
    assert sum(g[1] > 0 for g in got.values()) > 50


def test_edge_rows(spark):
    texts = [None, "", " \t\n", "a " * 23, "a " * 24, "a\x0bb\x0ca\rb\n" * 20, "é é " * 30, "a b " * 100_000]
    rows = [(i, t, "x") for i, t in enumerate(texts) if i is not None] + [(None, "q " * 40, "x"), (5, texts[5], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = runs.digests(runs.per_document(df)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].n_runs for k in range(8)] == [0, 0, 0, 0, 1, 1, 1, 1] and by[None].n_runs == 1
    assert (by[7].start, by[7].length, by[7].period, by[7].exponent_milli) == (0, 200_000, 2, 100_000_000)
    assert by[0].start is None and by[0].runs_sha256 == hashlib.sha256(b"").hexdigest() == by[0].collapsed_sha256
    assert by[4].collapsed_sha256 == hashlib.sha256(b"a").hexdigest() and by[6].period == 1
    assert runs.per_document(df.limit(0)).count() == 0
