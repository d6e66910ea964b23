"""Whole documents put together: lines by page with token kinds, metadata, the recovery log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import extract
from . import lines as L
from . import shapes as S

#: The metadata keys that have columns of their own, and their names.
META = {"Title": "title", "Author": "author", "Subject": "subject", "Keywords": "keywords", "Creator": "creator", "Producer": "producer", "CreationDate": "creation_date", "ModDate": "mod_date"}


def meta_wide(meta: DataFrame) -> DataFrame:
    """doc_id, the eight known keys as columns, and all as a map."""
    known = [F.max(F.when(F.col("key") == k, F.col("value"))).alias(c) for k, c in META.items()]
    return meta.groupBy("doc_id").agg(*known, F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("raw"))


def every_page(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """All pages of docs (doc_id, page_count), with the columns of pages (doc_id, page, ...) where it has them."""
    spine = docs.where("page_count > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page"))
    return spine.join(pages, ["doc_id", "page"], "left")


def merge_meta(*origins: DataFrame) -> DataFrame:
    """doc_id, key, value of several origins (doc_id, key, value); the last that has a key wins."""
    ranked = [o.select("doc_id", "key", "value", F.lit(-k).alias("__rank")) for k, o in enumerate(origins)]
    return reduce(DataFrame.union, ranked).groupBy("doc_id", "key").agg(F.min_by("value", "__rank").alias("value"))


def merge_lines(text: DataFrame, image: DataFrame, tie: str) -> DataFrame:
    """Lines of texts and of images as one list per document, numbered (``place``) by page, from the top, then by ``tie``."""
    w = Window.partitionBy("doc_id").orderBy("page", F.desc("y"), tie)
    return text.unionByName(image).withColumn("place", F.row_number().over(w))


def tokens_with_shapes(runs: DataFrame, annotations: DataFrame | None = None, **line_options) -> tuple[DataFrame, DataFrame]:
    """(tokens with kind and shape_seq, shapes). Shapes are inferred with default line options whatever is given for the lines."""
    placed = L.placed_tokens(runs, **line_options)
    inferred = S.shapes_from_tokens(L.placed_tokens(runs) if line_options else placed)
    given = S.shapes_from_annotations(annotations) if annotations is not None else inferred.limit(0)
    shapes = S.union_shapes(given, inferred)
    return S.attach_shapes(placed, shapes), shapes


def read(files: DataFrame, shape: str = "document", *, image_bytes: bool = False, line_options: dict | None = None, **options) -> DataFrame:
    """document: one nested row per file; text: text by page; shapes: links and contacts. Other shapes raise."""
    if shape == "text":
        return L.page_text(extract(files, "runs", **options), options.get("pages"))
    if shape == "shapes":
        return tokens_with_shapes(extract(files, "runs", **options), extract(files, "annotations", **options))[1]
    if shape != "document":
        raise ValueError(f"unknown_shape: {shape}")
    return assemble(files, image_bytes=image_bytes, line_options=line_options or {}, **options)


def assemble(files: DataFrame, *, image_bytes: bool = False, line_options: dict | None = None, **options) -> DataFrame:
    """doc_id, meta, pages (number, lines with tokens). Images are lines of one token of kind image; pages without lines stay."""
    runs, ann = extract(files, "runs", **options), extract(files, "annotations", **options)
    tokens, _ = tokens_with_shapes(runs, ann, **(line_options or {}))
    listed = tokens.groupBy("doc_id", "page", "line_no").agg(F.array_sort(F.collect_list(F.struct("token_no", "x", "text", "width", "kind"))).alias("tokens"))
    lines = L.lines_from_runs(runs, **(line_options or {})).select("doc_id", "page", "y", "x", "text", "line_no").join(listed, ["doc_id", "page", "line_no"], "left")
    blank = F.array().cast("array<struct<token_no:int,x:double,text:string,width:double,kind:string>>")
    text_lines = lines.select("doc_id", "page", "y", "x", "text", F.col("line_no").alias("o"), F.coalesce("tokens", blank).alias("tokens"), F.lit(None).cast("binary").alias("image"))
    img = extract(files, "images", **options)
    one = F.array(F.struct(F.lit(1).alias("token_no"), F.col("x"), F.lit("").alias("text"), F.col("render_width").alias("width"), F.lit("image").alias("kind")))
    image_lines = img.select("doc_id", "page", "y", "x", F.lit("").alias("text"), (F.col("seq") + 1_000_000).alias("o"), one.alias("tokens"), (F.col("bytes") if image_bytes else F.lit(None).cast("binary")).alias("image"))
    both = merge_lines(text_lines, image_lines, "o")
    pages = both.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("place", "y", "x", "text", "tokens", "image"))).alias("l"))
    pages = pages.select("doc_id", "page", F.transform("l", lambda r: F.struct(r["y"].alias("y"), r["x"].alias("x"), r["text"].alias("text"), r["tokens"].alias("tokens"), r["image"].alias("image"))).alias("lines"))
    docs = extract(files, "docs", **options)
    result = every_page(docs, pages).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page").alias("number"), "lines"))).alias("pages"))
    head = docs.join(meta_wide(extract(files, "meta", **options)), "doc_id", "left").join(result, "doc_id", "left")
    return head.select("doc_id", F.struct(*META.values(), "page_count", "version", "encrypted", "recovery_log", "raw").alias("meta"), "error", "pages")
