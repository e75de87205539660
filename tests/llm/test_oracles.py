import pytest

from seqloom.llm import queries
from tests.oracle import compare, connection

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_agrees_with_sql(spark, name):
    compare(spark, SF, queries.QUERIES[name], queries.ORACLE[name])


def test_scores_agree_to_the_last_bit(spark):
    rel = connection(SF).sql(queries.ORACLE["op9_hnsw"]).project("query_id, vec_id, score").fetchall()
    got = {(r.query_id, r.vec_id): r.score for r in queries.op9_hnsw(spark, SF).collect()}
    assert got == {(q, v): s for q, v, s in rel}


def test_targets_agree_to_the_last_bit(spark):
    rel = connection(SF).sql(queries.ORACLE["op3_mixing"]).project("doc_id, target").fetchall()
    assert {r.doc_id: r.target for r in queries.op3_mixing(spark, SF).collect()} == dict(rel)
