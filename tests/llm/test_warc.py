import base64
import hashlib
import random

import pytest

from seqloom.llm import common
from seqloom.llm import warc as w


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.choices(range(50), k=rng.choice([0, 1, 30]))) for _ in range(k)]
    got = list(w.LoserTree([iter([(x, (x, i)) for x in r]) for i, r in enumerate(runs)]))
    assert got == sorted((x, i) for i, r in enumerate(runs) for x in r)


@pytest.mark.parametrize("page", [0, 1, 15, 16, 2**40 + 7, 2**63 - 1, -1, -(2**63), None])
def test_record_ids(page):
    u = w.record_uuid(page, "u", "d")
    assert w.page_of(f"<{u.urn}>") == page and u.variant == w.uuid.RFC_4122


def test_url_keys():
    assert w.url_key("HTTP://www.Example.COM:80/A/?b=2&a=1") == "com,example)/a?a=1&b=2"
    assert w.url_key("http://x.org:8080") == "org,x:8080)/"
    for odd in ("urn:x-none:", "http://[bad", "", "not a url"):
        assert isinstance(w.url_key(odd), str)


def brute(rows, least):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same, default=None) if len(raw) >= least else None
        revisit = first is not None and page != first
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("least, per_file, file_bytes, bits", [(0, 512, 1 << 26, 1 << 28), (5, 3, 1000, 1 << 28), (0, 2, 1 << 20, 1 << 15)])
def test_round_trip(spark, monkeypatch, least, per_file, file_bytes, bits):
    monkeypatch.setattr(w, "FILE_RECORDS", per_file)
    monkeypatch.setattr(w, "FILE_BYTES", file_bytes)
    monkeypatch.setattr(common, "MOST_BITS", bits)
    trap = "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\n\r\n\r\n"
    rows = [(5, "http://a.com/", "same é"), (3, "http://b.com/x", "same é"), (9, None, "same é"), (1, "http://a.com/\r\nX: y", None), (2, "http://a.com/", ""), (7, "http://é.com/ü", trap), (8, "u", trap + "\n"), (-4, "http://z.org", "x" * 300_000), (None, "http://n.org", "n"), (None, "http://n.org", "same é"), (10, "http://a.com", "abcd")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, response int")
    out = w.write_and_read(df, least_bytes=least)
    assert rows_of(out) == brute(rows, least)
    ordered = [(r.url_key, r.captured_at) for r in out.orderBy("range", "capture").collect()]
    assert ordered == sorted(ordered, key=lambda x: (x[0].encode(), x[1]))


def test_real_and_empty(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert rows_of(w.write_and_read(pages)) == brute([(r.page_id, r.url, r.html) for r in pages.collect()], 0)
    assert w.write_and_read(pages.limit(0)).count() == 0


def test_rows_that_only_pass_the_filter_are_responses(spark, monkeypatch):
    """With one bit for all keys every page passes, and the join alone tells revisits from responses."""
    monkeypatch.setattr(common, "LEAST_BITS", 1)
    monkeypatch.setattr(common, "MOST_BITS", 1)
    rows = [(i, f"http://h{i % 3}.com/{i}", f"page {i % 17}") for i in range(120)] + [(None, "http://n.org", "page 3"), (4, "http://again.org", "page 4")]
    out = w.write_and_read(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert rows_of(out) == brute(rows, 0)
