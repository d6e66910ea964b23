"""Operator 4: held-out accuracy and defined cases."""

import random

import pytest
from foliospark.llm import quality

from .fixtures import awkward, documents, empty, prose


def junk(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(["BUY NOW!!!", "$$$ click", "free $$$ win", "### @@@", "|| menu ||", "!!! !!!"]) + str(r.randrange(9)) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    texts = [prose(k, 80) if k % 2 else junk(k) for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)] + [(5000, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    return documents(spark, texts), labels


def test_held_out(tables):
    docs, labels = tables
    got = quality.score(docs, quality.fit(docs, labels)).where("doc_id >= 200").collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)
    assert all(0 <= r.score <= 1 for r in got)


def test_same_model_on_any_partitioning(tables):
    docs, labels = tables
    a = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    b = {r.doc_id: r.score for r in quality.score(docs.repartition(9), quality.fit(docs.repartition(5), labels.repartition(3))).collect()}
    assert a == b


def test_awkward_rows(spark, tables):
    model = quality.fit(*tables)
    df, rows = awkward(spark)
    got = quality.score(df, model).collect()
    assert len(got) == len(rows)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert quality.score(empty(spark), model).count() == 0
    kept = quality.keep_good(df, model, below=0.0)
    assert kept.columns == df.columns and kept.count() == len(rows)


def test_labels_of_one_class_or_none(spark, tables):
    docs, labels = tables
    for some in (labels.limit(0), labels.where("quality = 1")):
        scores = {r.score for r in quality.score(docs, quality.fit(docs, some)).collect()}
        assert len(scores) == 1
