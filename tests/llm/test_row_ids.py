"""The pipeline's near-duplicate stage where ids are null or stand at several texts."""

import corpus_pipeline

from .fixtures import DOCUMENTS, prose


def test_null_and_repeated_ids(spark):
    a, b, c, d, e = (prose(k, 40) for k in range(5))
    rows = [(1, a), (None, a), (None, b), (None, b), (None, c), (2, d), (2, e), (2, e), (3, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCUMENTS)
    left = {(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
    ((_, two),) = {x for x in left if x[0] == 2}
    assert two in (d, e) and left - {(2, two)} == {(1, a), (None, b), (None, c)}
    again = corpus_pipeline.one_of_each(spark, docs.orderBy("text", ascending=False), "").where("doc_id = 2")
    assert [r.text for r in again.collect()] == [two]
