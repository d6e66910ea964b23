"""DataFrames to document bytes, and bytes to files."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Documents and bytes that one Arrow batch of made documents holds at most (one document may be larger).
BATCH_DOCUMENTS, BATCH_BYTES = 256, 4_000_000


def map_documents(df: DataFrame, make: Callable[[dict], bytes | None], id_col: str = "doc_id") -> DataFrame:
    """doc_id, content: the bytes that ``make`` gives of each row (None: no content). One row in, one out; no shuffle but for an input of few partitions."""
    names = df.columns

    def run(batches):
        for b in batches:
            ids, contents, size = [], [], 0
            for k in range(b.num_rows):
                (r,) = b.slice(k, 1).to_pylist()
                ids.append(r[id_col])
                contents.append(made := make(r))
                size += len(made or b"")
                if len(ids) >= BATCH_DOCUMENTS or size >= BATCH_BYTES or k + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(contents, pa.binary())], names=["doc_id", "content"])
                    ids, contents, size = [], [], 0

    rows = df.select(*[F.col(n).cast("long").alias(n) if n == id_col else F.col(n) for n in names])
    return spread(rows).mapInArrow(run, "doc_id long, content binary")


def texts_to_pdf(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, font: str = "Courier", font_size: float = 10, margin: float = 40, width: float = 595, lines_per_page: int = 50, user_password: str | None = None, owner_password: str | None = None, cipher: str = "aes128") -> DataFrame:
    """Each text as a document: one run per line of the text, lines unwrapped, characters that have no byte as '?'.

    A null text is an empty page."""

    def make(r: dict) -> bytes:
        from ..writer.pdf import Pdf

        step = font_size * 1.4
        doc = Pdf((width, 2 * margin + step * lines_per_page), margin).set_font(font, font_size)
        if title_col and r.get(title_col) is not None:
            doc.set_info(title=str(r[title_col]))
        for n, line in enumerate((r[text_col] or "").split("\n")):
            if n and n % lines_per_page == 0:
                doc.add_page()
            if line:
                doc.text_at(margin, doc.page.size[1] - margin - step * (n % lines_per_page + 1), line)
        options = {"user_password": user_password, "owner_password": owner_password, "cipher": cipher, "id_seed": str(r[id_col]).encode()}
        return doc.export(**options)

    return map_documents(df, make, id_col)


def render_templates(df: DataFrame, *, id_col: str = "doc_id", node_col: str = "node", order_col: str = "ord", config: dict | None = None) -> DataFrame:
    """A document per id from its nodes (JSON texts, one row each, in order). Nodes of one document meet in one task, as its bytes must."""
    grouped = df.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(node_col).alias("n")))).alias("nodes"))

    def make(r: dict) -> bytes:
        import json

        from ..writer.builder import render

        return render([json.loads(x["n"]) for x in r["nodes"]], config).export()

    return map_documents(grouped, make)


def write_files(docs: DataFrame, folder: str, suffix: str = ".pdf") -> DataFrame:
    """Writes content to folder/doc_id.suffix by pyarrow's file systems; path and length of each file come back.

    Names depend on the id alone and each file is moved into place whole, so a task that runs again writes the same files."""

    def run(batches):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        where.create_dir(base, recursive=True)
        for b in batches:
            paths, sizes = [], []
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = c or b""
                path = f"{base}/{i}{suffix}"
                with where.open_output_stream(path + ".part") as f:
                    f.write(c)
                where.move(path + ".part", path)
                paths.append(path)
                sizes.append(len(c))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["doc_id", "path", "length"])

    return docs.select(F.col("doc_id").cast("long"), F.col("content").cast("binary")).mapInArrow(run, "doc_id long, path string, length long")


def data_uri(kind: Column, content: Column) -> Column:
    return F.concat(F.lit("data:image/"), F.when(kind == "jpeg", "jpeg").otherwise("png"), F.lit(";base64,"), F.base64(content))


def png_images(images: DataFrame) -> DataFrame:
    """images with ``bytes`` as files: pixels become PNG, JPEG stays; pixels of no known layout become null. Adds encoded_format and data_uri."""

    @F.udf("binary", useArrow=True)
    def encode(kind, data, w, h):
        from ..binary.images import encode_png
        from ..binary.syntax import PdfError

        if kind == "jpeg" or data is None:
            return data
        try:
            return encode_png(bytes(data), w or 0, h or 0)
        except PdfError:
            return None

    out = images.withColumn("bytes", encode("kind", "bytes", "width", "height"))
    form = F.when(F.col("bytes").isNotNull(), F.when(F.col("kind") == "jpeg", "jpeg").otherwise("png"))
    return out.withColumn("encoded_format", form).withColumn("data_uri", F.when(form.isNotNull(), data_uri(F.col("kind"), F.col("bytes"))))
