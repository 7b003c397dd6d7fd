"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, each result is stored in the shared folder, and no node's
neighbours are ever gathered: a node with very many links costs rows, not memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(e: DataFrame) -> DataFrame:
    """Larger neighbours of u go to the smallest of u's neighbours and u itself."""
    s = _both(e)
    least = s.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return s.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours go to the smallest of them. In e, u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for all nodes of links (u, v); a component's id is its smallest node."""
    e = keep(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(most):
        last, e = e, keep(_small(_large(e)), "links")
        discard(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most} rounds")
