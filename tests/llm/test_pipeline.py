import re
from collections import Counter

import corpus_pipeline
from seqloom.llm import mixing, ngram_join
from seqloom.llm.byte_bpe import load
from seqloom.llm.common import pinned
from tests.llm.test_mixing import SIZE, brute_targets
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    out = {"raw": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = pinned(stage(spark, docs, SF), name)
        if name != names[-1]:
            assert docs.columns == out["raw"].columns
    rows = {k: v.collect() for k, v in out.items()}

    # toxicity: what goes is labelled toxic or unlabelled, and most of what is labelled toxic goes
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in rows["toxicity"]}
    gone = {r.doc_id for r in rows["raw"]} - kept
    assert not [i for i in gone if labels.get(i) == 0]
    assert {r.doc_id: r.text for r in rows["raw"] if r.doc_id in kept} == {r.doc_id: r.text for r in rows["toxicity"]}

    # near duplicates: exactly the least id of each class of the brute-force join
    want = {c for _, c, _, _ in brute([(r.doc_id, r.text) for r in rows["toxicity"]])}
    assert Counter(r.doc_id for r in rows["near_duplicates"]) == Counter(want)

    # personal data: same documents, none of the planted forms as they were
    finder = re.compile(r"[\w.+-]+@[\w.-]+\.\w+|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b[0-9a-f]{40}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b")
    after = {r.doc_id: r for r in rows["pii"]}
    assert set(after) == want
    for r in rows["near_duplicates"]:
        assert all(x not in after[r.doc_id].text for x in finder.findall(r.text))
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text)

    # mixing: words by source at their targets, copies within bounds
    size = {r.doc_id: len(SIZE.findall(r.text)) for r in rows["pii"]}
    by_source, taken, each = Counter(), Counter(), Counter()
    for r in rows["pii"]:
        by_source[r.source] += size[r.doc_id]
    for r in rows["mixing"]:
        n = len(SIZE.findall(r.text))
        taken[r.source] += n
        each[r.doc_id] += n
        assert after[r.doc_id] == r  # whole
    longest = Counter()
    for r in rows["pii"]:
        longest[r.source] = max(longest[r.source], size[r.doc_id])
    assert all(abs(taken[s] - t) <= longest[s] / 2 + 1 for s, t in brute_targets(dict(by_source)).items())
    assert all(each[i] <= 2 * size[i] for i in each)

    # encoding: a row a row, ids of the texts
    import public_tokenizers

    bpe = load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    want_tokens = Counter((r.doc_id, len(bpe.encode_batch([r.text])[0])) for r in rows["mixing"])
    assert Counter((r.doc_id, r.n_tokens) for r in rows["byte_bpe"]) == want_tokens


def test_run_and_edges(spark, tmp_path):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (None, "mail x@y.example.com now", "en", None, 24), (3, "", "en", "s", 0), (4, "w " * 50_000, "en", "t", 100_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    for d in "ab":
        spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{d}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() >= 3
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
    assert mixing and ngram_join
