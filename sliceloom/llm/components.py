"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node goes to the least of the node and all its neighbours. ``edges`` have u > v, and so has the result, in which edges may repeat."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = edges.select("u", "v").union(turned).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return turned.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of these. ``edges`` have u > v, and so has the result."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
    # only a node with several smaller neighbours moves any
    moved = edges.join(least.where("m != most").select("u", "m"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether each node has one neighbour below it at most, which has none. With u > v, rounds then change nothing any more."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    met = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return met.agg(F.count_if((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0)))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge.

    Alternates large-star and small-star rounds until only stars are left, each written
    to the shared folder, so that no plan holds another's. ``edges`` has columns u and v; loops and
    repeated edges do no harm.
    """
    now = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _only_stars(now):
        now = materialize(_small_star(materialize(_large_star(now), "large-stars")), "stars")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
