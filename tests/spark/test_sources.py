"""Files in and out: extraction, results, the data source, SQL functions, streams."""

import base64

import pytest
from foliospark import schemas
from foliospark.functions import codes
from foliospark.operators import result
from foliospark.sources import datasource, sinks
from foliospark.sources.files import extract, read_files
from foliospark.streaming import ingest
from foliospark.writer.pdf import Pdf
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    doc = Pdf("a4", 40).set_info(title="One").set_font("Courier", 10)
    doc.text("write to me@x.org or see https://x.org/page").link((0, 0, 600, 850), page=2).add_page().add_page().text("third page")
    from foliospark.binary.images import encode_png

    doc.image(encode_png(bytes(12), 2, 2), 50, 60, 20, 20)
    doc.write_to(str(path / "a.pdf"))
    Pdf("a4", 40).text("locked").write_to(str(path / "b.pdf"), user_password="pw", cipher="rc4")
    (path / "c.pdf").write_bytes(b"no document")
    (path / "d.txt").write_bytes(b"other")
    return str(path)


def test_tables_of_files(spark, folder):
    files = read_files(spark, folder)
    assert files.count() == 3
    docs = {r.path.rsplit("/", 1)[1]: r for r in extract(files, "docs").collect()}
    assert (docs["a.pdf"].page_count, docs["a.pdf"].error) == (3, None)
    assert docs["b.pdf"].error.code == "password_required" and docs["c.pdf"].error.code == "not_a_pdf"
    assert sorted(r.text for r in extract(files, "runs", password="pw").collect())[0] == "locked"
    own = files.withColumn("pw", F.when(F.col("path").endswith("b.pdf"), "pw"))
    assert extract(own, "docs", passwords="pw").where("encrypted and error is null").count() == 1
    assert {r.page for r in extract(files, "runs", pages=[3]).collect()} == {3}
    for t in schemas.ALL:
        extract(files, t).collect()
    with pytest.raises(ValueError):
        extract(files, "nothing")
    with pytest.raises(Exception, match="password_required|not_a_pdf"):
        extract(files, "runs", mode="FAILFAST").collect()


def test_results(spark, folder):
    files = read_files(spark, folder).where("path like '%a.pdf'")
    r = result.read(files, image_bytes=True).first()
    assert r.meta.title == "One" and r.meta.page_count == 3 and [p.number for p in r.pages] == [1, 2, 3] and r.pages[1].lines is None
    kinds = {t.kind for ln in r.pages[0].lines for t in ln.tokens}
    assert kinds == {"email"}  # one run is one token, and the shape that stands higher is the first
    assert [t.kind for ln in r.pages[2].lines for t in ln.tokens].count("image") == 1
    assert [x.text for x in result.read(files, "text").orderBy("page").collect()] == ["write to me@x.org or see https://x.org/page", "third page"]
    assert {(x.type, x.source) for x in result.read(files, "shapes").collect()} >= {("goto", "annotation"), ("email", "inferred")}
    with pytest.raises(ValueError):
        result.read(files, "other")


def test_images_as_files(spark, folder):
    img = sinks.png_images(extract(read_files(spark, folder), "images")).first()
    assert img.encoded_format == "png" and base64.b64decode(img.data_uri.split(",")[1]) == bytes(img.bytes) and bytes(img.bytes)[:4] == b"\x89PNG"


def test_writing_and_reading_back(spark, tmp_path):
    texts = spark.createDataFrame([(1, "one\ntwo"), (2, None), (3, "x\n" * 120)], "doc_id long, text string")
    written = sinks.write_files(sinks.texts_to_pdf(texts), str(tmp_path / "out"))
    assert {r.doc_id for r in written.collect()} == {1, 2, 3}
    back = extract(read_files(spark, str(tmp_path / "out")), "docs")
    assert sorted(r.page_count for r in back.collect()) == [1, 1, 3]
    assert sinks.texts_to_pdf(texts.limit(0)).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, content binary")
    assert extract(null, "docs").first().error.code == "not_a_pdf"


def test_templates(spark):
    nodes = spark.createDataFrame([(1, 1, '{"type": "text", "content": "second"}'), (1, 0, '{"type": "header", "text": "first"}'), (2, 0, '{"type": "qr", "data": "x"}')], "doc_id long, ord int, node string")
    got = extract(sinks.render_templates(nodes, config={"margin": 30}), "runs").orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.text) for r in got] == [(1, "first"), (1, "second")]


def test_data_source(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    datasource.register(spark)  # enables what its filters need
    df = spark.read.format("folio").option("table", "runs").option("password", "pw").load(folder)
    assert df.count() == 3
    assert [r.text for r in df.where("page = 3").collect()] == ["third page"]
    docs = spark.read.format("folio").option("table", "docs").load(folder)
    assert docs.where(F.col("path") == f"{folder}/a.pdf").first().page_count == 3
    assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in read_files(spark, folder).select("doc_id").collect()}
    assert spark.read.format("folio").option("table", "meta").load(folder + "/a*.pdf").first().value == "One"


def test_sql_functions(spark, folder):
    codes.register(spark)
    read_files(spark, folder).createOrReplaceTempView("files")
    assert spark.sql("select pdf_text(content) t from files where path like '%a.pdf'").first().t == "write to me@x.org or see https://x.org/page\fthird page"
    assert spark.sql("select r.text from files, lateral pdf_text_runs(content, 'pw') r where path like '%b.pdf'").first().text == "locked"
    r = spark.sql("select code128('AB') b, code128('é') n, size(pdf_qr('x')) q").first()
    assert sum(r.b) == 11 * 4 + 13 and r.n is None and r.q == 21
    assert spark.sql("select code128('A') is not null ok").select("ok").first().ok


def test_streams(spark, folder, tmp_path):
    for want in (3, 4):
        ingest.start(spark, folder, str(tmp_path / "out"), str(tmp_path / "log"), table="docs").awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == want
        Pdf().text("late").write_to(f"{folder}/late.pdf")
    import os

    os.remove(f"{folder}/late.pdf")


def test_windows_of_streams(spark, tmp_path):
    rows = spark.sql("select id as event_id, timestamp'2026-01-01' + make_interval(0,0,0,0,0,id * 20) as ts, id % 2 as user_id, 'a' as event_type, 1.0D as value from range(12)")
    rows.write.parquet(str(tmp_path / "in"))
    batch = {(r.start, r.n) for r in ingest.windowed_counts(rows).collect()}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ingest.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.start, r.n) for r in spark.table("w").collect()} == batch and len(batch) == 4
    assert ingest.sessions(rows).count() == 12 and ingest.sessions(rows, gap="1 hour").count() == 2


def test_made_documents_leave_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(sinks, "BATCH_BYTES", 100)
    rows = spark.range(0, 700, 1, 1).withColumnRenamed("id", "doc_id")
    made = sinks.map_documents(rows, lambda r: None if r["doc_id"] == 3 else b"x" * (r["doc_id"] % 90)).collect()
    assert sorted((r.doc_id, None if r.content is None else len(r.content)) for r in made) == [(k, None if k == 3 else k % 90) for k in range(700)]
