"""Connected components of links, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join that AQE may split,
so a node with very many links never lands whole in one task; links that two nodes share
collapse at once. Each round is cut by a checkpoint in the shared folder, so a lost executor
costs the round and not the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a < b. Large: each node's larger neighbours move to its smallest; small: its smaller ones and itself."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return moved.where("a < b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) of every node that has a link to another one.

    links: two integer columns, in any order, repeated or to itself. Raises if ``rounds`` do not suffice
    (the number needed grows with the logarithm of the size)."""
    edges = cut(links.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).where("a < b").distinct())
    was = None
    for _ in range(rounds):
        edges = cut(_star(_star(edges, True), False))
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == was or not row[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        was = tuple(row)
    raise RuntimeError(f"no fixed point within {rounds} rounds")
