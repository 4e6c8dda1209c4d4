"""Connected components of an edge table by alternating large-star and
small-star rounds (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014).  Every round is a grouped minimum and an equi-join; no
component is ever gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, root): the smallest node each is joined to.
    Only nodes with an edge are returned; null ends and loops are ignored."""
    checkpoint_dir(edges.sparkSession)
    pairs = (edges.where(F.col("a") != F.col("b"))
             .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct().checkpoint())
    before = None
    while True:
        pairs = _small_star(_large_star(pairs)).checkpoint()
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, "u").where("v <> m")
            .select(F.greatest("v", "m").alias("v"), F.least("v", "m").alias("u")).distinct())


def _small_star(pairs: DataFrame) -> DataFrame:
    """``pairs`` are (v > u): the smaller neighbours of v are its u."""
    least = pairs.groupBy("v").agg(F.min("u").alias("m"))
    moved = pairs.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.union(least.select("v", F.col("m").alias("u"))).distinct()
