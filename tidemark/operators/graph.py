"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` of longs: ``(node, root)``, root the least node.

    Alternating large-star and small-star steps (Kiveris et al. 2014); each step's edges are written to the shared
    folder, until they no longer change. Nodes without edges don't appear. Hot nodes only meet a partial minimum and a join
    with unique keys.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else both
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a != b").distinct()

    def summary(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    seen, before = summary(now), None
    while seen[0] and seen != before:
        now = materialize(star(star(now, True), False))
        seen, before = summary(now), seen
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
