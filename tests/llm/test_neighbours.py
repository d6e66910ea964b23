"""Operator 10: an item that stands beside others is found like one that stands alone."""

from foliospark.llm import decontam

from .fixtures import documents, prose


def test_items_side_by_side(spark):
    # short words give few gate pairs, long ones many: the dense item must not hide the sparse one
    sparse = [" ".join(w[:3] if k % 5 else w for k, w in enumerate(prose(600 + i, 30).split())) for i in range(10)]
    dense = [" ".join(w + "longer" for w in prose(700 + i, 30).split()) for i in range(10)]
    items = [t for two in zip(sparse, dense, strict=True) for t in two]
    texts = [f"{prose(800 + i, 40)} {sparse[i]} {dense[i]} {prose(900 + i, 40)}" for i in range(10)] + [" ".join(items)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find(documents(spark, texts), bench).collect()}
    want = {(i, k) for i in range(10) for k in (2 * i, 2 * i + 1)} | {(10, k) for k in range(20)}
    assert want <= got
