"""Bookmark trees in the order in which they are walked, and destinations by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def preorder(rows: DataFrame, path: list[str]) -> DataFrame:
    """rows with ``place`` (from 1) in pre-order of the whole tree: paths sort as the tree is walked, parents (null below them) first.

    Places are counted within a root; the sizes of the roots before it are added by a join, so no task holds more than a root's
    branch and nothing is broadcast."""
    root, *below = path
    order = [F.asc_nulls_first(c) for c in below]
    sizes = rows.groupBy(root).agg(F.count("*").alias("__n"))
    # one row per root: as many as the tree has top entries
    before = sizes.select(F.col(root).alias("__root"), (F.sum("__n").over(Window.orderBy(F.asc_nulls_first(root))) - F.col("__n")).alias("__before"))
    numbered = rows.withColumn("__k", F.row_number().over(Window.partitionBy(root).orderBy(*order)))
    return numbered.join(before, F.col(root).eqNullSafe(F.col("__root"))).withColumn("place", F.col("__k") + F.col("__before")).drop("__root", "__before", "__k")


def resolve_names(links: DataFrame, names: DataFrame, pages: DataFrame) -> DataFrame:
    """links (dest) with dest_page: dest by name (name, target), then target by page (target, page_index from 0); null where either is missing."""
    found = links.join(names, links["dest"] == names["name"], "left").drop("name")
    return found.join(pages, "target", "left").withColumn("dest_page", F.col("page_index") + 1).drop("page_index", "target")
