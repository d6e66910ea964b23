"""Round trips: tables written as documents and read back; the oracle is the identity on the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import result
from ..session import spread
from ..sources import sinks
from ..sources.files import extract
from .q_text import read
from .registry import query

_WIN = r"regexp_replace(nfc_normalize(text), '[^\x{20}-\x{7E}\x{A0}-\x{FF}\x{152}\x{153}\x{160}\x{161}\x{178}\x{17D}\x{17E}\x{192}\x{2C6}\x{2DC}\x{2013}\x{2014}\x{2018}-\x{201A}\x{201C}-\x{201E}\x{2020}-\x{2022}\x{2026}\x{2030}\x{2039}\x{203A}\x{20AC}\x{2122}\n]', '?', 'g')"


def files(spark, sf_dir, table="documents", id_col="doc_id", **options):
    docs = read(spark, sf_dir, table).select(F.col(id_col).alias("doc_id"), "text", *(["lang"] if table == "documents" else []))
    return sinks.texts_to_pdf(docs, title_col="lang" if table == "documents" else None, **options)


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split({_WIN}, chr(10))) AS line, generate_subscripts(string_split({_WIN}, chr(10)), 1) - 1 AS n FROM documents)
SELECT doc_id, CAST(n // 50 + 1 AS INTEGER) AS page, CAST(count(*) AS BIGINT) AS runs, md5(string_agg(line, chr(10) ORDER BY n)) AS digest FROM l WHERE line <> '' GROUP BY ALL""")
def pdf_roundtrip_text(spark, sf_dir):
    """documents written, parsed and decoded again, line by line."""
    runs = extract(files(spark, sf_dir), "runs")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda r: r["text"]), "\n")
    return runs.groupBy("doc_id", "page").agg(F.count("*").alias("runs"), F.md5(text.cast("binary")).alias("digest"))


@query("SELECT doc_id, CAST(greatest(1, (len(string_split(coalesce(text, ''), chr(10))) + 49) // 50) AS INTEGER) AS page_count, '1.7' AS version, false AS encrypted FROM documents")
def pdf_page_count(spark, sf_dir):
    return extract(files(spark, sf_dir), "docs").select("doc_id", "page_count", "version", "encrypted")


@query("SELECT doc_id, 'Title' AS key, lang AS value FROM documents WHERE lang IS NOT NULL")
def pdf_roundtrip_meta(spark, sf_dir):
    return extract(files(spark, sf_dir), "meta").select("doc_id", "key", "value")


@query(f"WITH l AS (SELECT doc_id, unnest(string_split({_WIN}, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS runs, sum(length(line))::BIGINT AS chars FROM l WHERE line <> '' GROUP BY doc_id")
def encrypted_roundtrip(spark, sf_dir):
    """AES-128 with passwords of user and owner (AES-256 takes seconds a file to derive its key in plain Python; tests cover it)."""
    made = files(spark, sf_dir, user_password="u", owner_password="o", cipher="aes128")
    return extract(made, "runs", password="o").groupBy("doc_id").agg(F.count("*").alias("runs"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id, true AS recovered, CAST(greatest(1, (len(string_split(coalesce(text, ''), chr(10))) + 49) // 50) AS INTEGER) AS page_count FROM documents")
def recover_truncated(spark, sf_dir):
    """Files that lost their cross references are rebuilt from their objects."""
    cut = files(spark, sf_dir).withColumn("content", F.expr("substring(content, 1, length(content) - 40)"))
    return extract(cut, "docs").select("doc_id", F.exists("recovery_log", lambda e: e["event"] == "xref_recovered").alias("recovered"), "page_count")


@query(f"WITH l AS (SELECT doc_id, unnest(string_split({_WIN}, chr(10))) AS line, generate_subscripts(string_split({_WIN}, chr(10)), 1) - 1 AS n FROM documents) SELECT doc_id, CAST(2 AS INTEGER) AS page, count(*) AS runs FROM l WHERE line <> '' AND n // 50 = 1 GROUP BY doc_id")
def pages_pushdown(spark, sf_dir):
    """Only the second page's content of each file is read."""
    return extract(files(spark, sf_dir), "runs", pages=[2]).groupBy("doc_id", "page").agg(F.count("*").alias("runs"))


@query("SELECT doc_id, lang AS title, CAST(greatest(1, (len(string_split(coalesce(text, ''), chr(10))) + 49) // 50) AS INTEGER) AS page_count, CAST(greatest(1, (len(string_split(coalesce(text, ''), chr(10))) + 49) // 50) AS INTEGER) AS pages FROM documents")
def read_documents(spark, sf_dir):
    """The nested result of each file: metadata, and all pages with their lines."""
    return result.read(files(spark, sf_dir)).select("doc_id", F.col("meta.title").alias("title"), F.col("meta.page_count").alias("page_count"), F.size("pages").alias("pages"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS flate, sha256(coalesce(text, '')) AS ascii85, sha256(coalesce(text, '')) AS ascii_hex FROM documents")
def codec_roundtrip(spark, sf_dir):
    """Texts encoded by Python's own codecs and decoded by the filters."""

    @F.udf("struct<flate: string, ascii85: string, ascii_hex: string>", useArrow=True)
    def trip(t):
        import base64
        import hashlib
        import zlib

        from foliospark.binary import filters

        raw = (t or "").encode()
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return sha(filters.flate(zlib.compress(raw), {})), sha(filters.ascii85(base64.a85encode(raw) + b"~>", {})), sha(filters.ascii_hex(raw.hex().encode() + b">", {}))

    return spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", trip("text").alias("t")).select("doc_id", "t.*")


@query("SELECT r_regionkey AS doc_id, CAST(1 AS INTEGER) AS pages, count(*) + 2 AS texts FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def rendered_tables(spark, sf_dir):
    """A report per region: a header, a bar code and a table of its nations, from one node a row."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    rows = nation.groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.array("n_name")))).alias("rows"))
    node = lambda ord, json: region.join(rows, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("doc_id"), F.lit(ord).alias("ord"), json.alias("node"))
    nodes = node(0, F.to_json(F.struct(F.lit("header").alias("type"), F.col("r_name").alias("text"))))
    nodes = nodes.union(node(1, F.to_json(F.struct(F.lit("barcode").alias("type"), F.lit(200).alias("width"), F.col("r_name").alias("data")))))
    nodes = nodes.union(node(2, F.concat(F.lit('{"type": "table", "rows": '), F.col("rows"), F.lit("}"))))
    made = sinks.render_templates(nodes, config={"margin": 40})
    docs, runs = extract(made, "docs"), extract(made, "runs")
    texts = runs.where("text <> ''").groupBy("doc_id").agg(F.count("*").alias("texts"))
    return docs.join(texts, "doc_id").select("doc_id", F.col("page_count").alias("pages"), "texts")
