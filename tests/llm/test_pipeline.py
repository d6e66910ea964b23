"""The pipeline over a small corpus, each stage against what it must drop and keep."""

import corpus_pipeline
from foliospark.llm import queries

from .fixtures import awkward, documents, prose
from .test_quality import junk


def test_stages(spark, tmp_path):
    item, passage = prose(77, 30), prose(78, 70)
    texts = [prose(k, 120) for k in range(60)]
    texts[10] = texts[4]
    texts[11] = texts[5] + " more"
    texts[20] += " " + passage
    texts[21] += " " + passage
    texts[30] = texts[30][:300] + " " + item + " " + texts[30][300:]
    texts += [junk(k) for k in range(60, 110)]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(110)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        had = docs
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        gone = {r.doc_id for r in had.collect()} - {r.doc_id for r in docs.collect()}
        assert gone == {"quality": set(range(60, 110)), "near_duplicates": {10, 11}, "passages": set(), "decontamination": {30}}[name]
    left = {r.doc_id: r.text for r in docs.collect()}
    assert passage in left[20] and passage not in left[21]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(left) and all(r.lossless for r in out)


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))


def test_awkward_tables(spark, tmp_path):
    df, rows = awkward(spark)
    good = spark.createDataFrame([(100 + k, prose(300 + k, 80), None, None, None, "k", 1, "f") for k in range(60)], df.schema)
    bad = spark.createDataFrame([(200 + k, junk(k), None, None, None, "k", 1, "f") for k in range(60)], df.schema)
    labels = spark.createDataFrame([(100 + k, 1, 0) for k in range(60)] + [(200 + k, 0, 0) for k in range(60)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "an item that stands nowhere in these texts at all"), (None, "x"), (2, None)], "item_id long, text string")
    for name, docs in (("full", df.union(good).union(bad)), ("empty", df.limit(0))):
        at = tmp_path / name
        docs.write.parquet(str(at / "documents.parquet"))
        labels.write.parquet(str(at / "labels.parquet"))
        bench.write.parquet(str(at / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(at)).collect()
        assert all(r.lossless for r in out)
        # clean prose stays, the very long text too, and junk goes
        ids = {r.doc_id for r in out}
        if name == "full":
            assert set(range(100, 160)) | {7} <= ids
            assert not ids & set(range(200, 260))
        else:
            assert not out
