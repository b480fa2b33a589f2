"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the smallest vertex of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("k"), F.least("u", "low").alias("low"))
    return both.filter(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("k")).select(
        F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour, and the vertex itself, is tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    tied = down.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).filter(F.col("v") != F.col("low")).select(
        F.col("v").alias("u"), F.col("low").alias("v"))
    return tied.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for every id of ``edges`` (``u, v`` longs), roots included; the root is the smallest id.

    Minima are combined before the shuffle and the joins have a unique side,
    so a vertex with very many neighbours does not land in one task.  Each
    round is written to the shared folder; rounds grow with the logarithm of
    the size of a component.
    """
    stars = common.staged(edges.filter("u <> v").distinct(), "edges")
    state = None
    while True:
        stars = common.staged(_small_star(_large_star(stars)), "stars")
        seen = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = stars.select(F.col("v").alias("id")).distinct()
    return stars.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots.select("id", F.col("id").alias("root")))
