"""Operator 6: edits, likeness, and the oracle."""

import hashlib

from foliospark.llm import merkle
from pyspark.sql import functions as F

from .fixtures import awkward, documents, empty, prose


def test_edits_follow_document_order(spark):
    texts = ["abcdef", "XYZ", None, "", "naïve 😀😀"]
    got = {r.doc_id: r for r in merkle.fingerprint_edits(documents(spark, texts, start=10)).collect()}
    for k in range(5):
        t, n = texts[k] or "", texts[(k + 1) % 5] or ""
        half = len(t) // 2
        want = t[: len(t) - half] + n[:half]
        assert got[10 + k].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[10 + k].n_chars == len(t)


def test_many_groups_keep_each_successor(spark):
    ids = sorted({(k * k * 7919) % 100_003 for k in range(3000)})
    df = spark.createDataFrame([(i, f"text {i} of {i}") for i in ids], "doc_id long, text string").repartition(5)
    dealt = merkle.deal_in_order(df, group=64)
    from pyspark.sql import Window

    w = Window.partitionBy("__g").orderBy("__last", "__k", "text")
    got = {r.doc_id: r.n for r in dealt.withColumn("n", F.lead("text").over(w)).where("__last = 0").collect()}
    assert got == {i: f"text {ids[(k + 1) % len(ids)]} of {ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


def test_equal_texts_are_equal_and_edits_are_located(spark):
    a = "\n".join(prose(k, 12) for k in range(40))
    b = a.replace(a.split("\n")[20], "another line")
    row = spark.createDataFrame([(a, a, b)], "a string, a2 string, b string").select(merkle.fingerprint(F.col("a")).alias("x"), merkle.fingerprint(F.col("a2")).alias("y"), merkle.fingerprint(F.col("b")).alias("z"), merkle.changes(F.col("a"), F.col("b")).alias("c"), merkle.likeness(*[merkle.distinct_leaves(merkle.leaves(F.col(c))) for c in "ab"]).alias("near")).first()
    assert row.x == row.y != row.z
    assert row.c.paragraphs == [20]
    assert 0.8 < row.near < 1


def test_awkward_rows(spark):
    df, rows = awkward(spark)
    got = merkle.fingerprint_edits(df).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert merkle.fingerprint_edits(empty(spark)).count() == 0
    one = merkle.fingerprint_edits(documents(spark, ["only one"])).first()
    assert one.near_next == 1.0


def test_oracle(spark, tmp_path):
    import duckdb

    docs = documents(spark, [prose(k, 30 + k) + "\n" + prose(k + 1, 5) for k in range(50)] + ["", "x"])
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    want = con.execute(merkle.ORACLE).fetchdf().sort_values("doc_id").reset_index(drop=True)
    got = merkle.fingerprint_edits(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    for c in want.columns:
        assert (got[c].astype(str) == want[c].astype(str)).all(), c
