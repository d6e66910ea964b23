"""Codes as columns, and all functions for SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

# types are objects: workers import this module, and a type in words needs a session
_RUN = T.StructType([T.StructField(n, t()) for n, t in (("page", T.IntegerType), ("seq", T.IntegerType), ("text", T.StringType), ("x", T.DoubleType), ("y", T.DoubleType), ("font", T.StringType), ("size", T.DoubleType))])


def code128_b_checksum(text: Column) -> Column:
    """Check value of a text in code set B alone (no run of four digits)."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c) - 32)
    weighted = F.aggregate(F.transform(codes, lambda v, i: v * (i + 1)), F.lit(104), lambda a, b: a + b)
    return weighted % 103


def _safe(fn):
    def one(t):
        try:
            return None if t is None else fn(t)
        except ValueError:
            return None

    return one


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def code128_bars(text: pd.Series) -> pd.Series:
    """Bar and space widths; null where the text cannot be encoded."""
    from ..codes import code128

    return text.map(_safe(code128.encode))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def qr_modules(text: pa.Array) -> pa.Array:
    """Rows of modules; null where the text is too long. The symbols of a batch are made together."""
    from ..codes import qr

    made = qr.encode_all(text.to_pylist())
    sizes = np.array([0 if m is None else len(m) for m in made], np.int64)
    values = np.concatenate([np.empty(0, np.int32), *[m.ravel() for m in made if m is not None]]).astype(np.int32)
    starts = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    rows = pa.ListArray.from_arrays(starts(np.repeat(sizes, sizes)), pa.array(values))
    return pa.ListArray.from_arrays(starts(sizes), rows, mask=pa.array(sizes == 0))


@F.pandas_udf(T.IntegerType())
def qr_version(text: pd.Series) -> pd.Series:
    from ..codes import qr

    return text.map(_safe(lambda t: qr.min_version(len(t.encode()), "M"))).astype("Int32")


@F.pandas_udf(T.StringType())
def pdf_text(content: pd.Series) -> pd.Series:
    """Runs of all pages by spaces, pages by form feeds."""
    from ..binary.extract import extract

    def one(b):
        if b is None:
            return None
        pages: dict[int, list[str]] = {}
        for r in extract(bytes(b), {"runs"})["runs"]:
            pages.setdefault(r["page"], []).append(r["text"])
        return "\f".join(" ".join(pages[k]).strip() for k in sorted(pages))

    return content.map(one)


@udtf(returnType=_RUN)
class PdfTextRuns:
    """SELECT ... FROM files, LATERAL pdf_text_runs(content, password)"""

    def eval(self, content, password=""):
        from ..binary.extract import extract

        for r in extract(bytes(content or b""), {"runs"}, password=password or "")["runs"]:
            yield r["page"], r["seq"], r["text"], r["x"], r["y"], r["font"], r["size"]


def register(spark: SparkSession) -> None:
    """SQL names: pdf_text, pdf_text_runs, pdf_qr, code128."""
    spark.udf.register("pdf_text", pdf_text)
    spark.udf.register("pdf_qr", qr_modules)
    spark.udf.register("code128", code128_bars)
    spark.udtf.register("pdf_text_runs", PdfTextRuns)
