"""The registered query against a plain version: patterns of its own to find what was planted, replacement by splicing, and tables of
all originals and surrogates to compare."""

import re

from seqloom.llm import queries, surrogates

SF = "/root/testdata/sf0.01"
#: What the documents hold, told by forms of this test's own.
PLANTED = {
    "email": re.compile(r"[A-Za-z0-9_.+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    "phone": re.compile(r"\+1 \(\d{3}\) \d{3}-\d{4}"),
    "card": re.compile(r"(?<!\d)\d{16}(?!\d)"),
    "ipv4": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"),
}


def test_against_a_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = surrogates.pseudonymise(spark.read.parquet(f"{SF}/documents.parquet"), queries.SURROGATE_KEY).collect()
    got = {r.doc_id: r for r in queries.op4_surrogates(spark, SF).collect()}
    forward, backward, planted = {}, {}, 0
    for r in rows:
        text, at, out = docs[r.doc_id] or "", 0, []
        for e in sorted(r.entities, key=lambda e: e.start):
            assert e.start >= at and text[e.start : e.start + len(e.original)] == e.original != e.surrogate
            out += [text[at : e.start], e.surrogate]
            at = e.start + len(e.original)
            # one original has one surrogate in all documents, and no two share one
            assert forward.setdefault((e.type, e.original), e.surrogate) == e.surrogate
            assert backward.setdefault((e.type, e.surrogate), e.original) == e.original
        assert "".join([*out, text[at:]]) == r.text == got[r.doc_id].text and got[r.doc_id].n_entities == len(r.entities)
        spans = [(e.start, e.start + len(e.original), e.type) for e in r.entities]
        for kind, form in PLANTED.items():
            for m in form.finditer(text):
                planted += 1
                held = [t for a, b, t in spans if a <= m.start() and m.end() <= b]
                assert held and (kind in held or "assigned" in held or "secret" in held), (kind, m[0], held)
    assert len(got) == len(docs) and planted > 50
