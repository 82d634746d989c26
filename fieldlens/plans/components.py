"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.plans.lineage import materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root) for every vertex of edges (a, b): root is the smallest vertex it can reach.

    Alternating large-star and small-star rounds; each keeps the components,
    never holds a vertex's neighbours together, and is cut off from the last by
    a checkpoint. Rounds grow with the logarithm of the longest path. Null ends
    and loops are dropped.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1000003), F.lit(0)).alias("h")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        both = now.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(now.select(F.col("b").alias("v"), F.col("a").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("k"), F.least("v", "m").alias("m"))
        large = both.filter("u > v").join(least, F.col("v") == F.col("k")).select(F.col("u").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large)
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
        now = materialize(small.filter("a <> b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root"))).groupBy("id").agg(F.min("root").alias("root"))
