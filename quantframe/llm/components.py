"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize


def _nearest(arcs: DataFrame, total: int, hubs: bool) -> DataFrame:
    """arcs (u, v) with m, the least of u and all its v; minima are pre-aggregated before they are shuffled, and those of hubs are sent to all tasks."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m"), F.count("v").alias("c")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"), "c")
    joined = join_counted(arcs, ["u"], least, ["k"], total) if hubs else arcs.join(least, arcs["u"] == least["k"])
    return joined.select("u", "v", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id on an edge (u, v): root is the smallest id that it reaches.

    Each round is two grouped minima and joins over the edges left; rounds grow with the logarithm of a
    component's width, and end when every component is a star around its root. No component is gathered anywhere.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        degrees = both.groupBy("u").agg(F.count("v").alias("c"), F.min("v").alias("m"))
        # stars: whoever has a smaller neighbour has no other
        total, most, inner = degrees.agg(F.sum("c"), F.max("c"), F.count(F.when(F.expr("m < u and c > 1"), 1))).first()
        if not inner:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        hubs = most > max(1000, total // 100_000)
        large = _nearest(both, total, hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        stars = _nearest(large, total, hubs)
        small = stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(stars.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "edges")
