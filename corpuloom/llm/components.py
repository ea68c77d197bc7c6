"""Connected components of a graph of pairs, by alternating large-star and small-star steps.

Each step is a group-by on nodes with a minimum, no task ever holds a component, and the number of
rounds is logarithmic in practice. Every round is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuloom.operators.skew import hot_keys, spread_join
from corpuloom.runtime import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest of a node's neighbourhood: the larger ones, or the smaller ones and itself."""
    if large:
        seen = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialise(seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")))
    joined = spread_join(seen, least.select("a", "m"), "a", "b", hot_keys(least, "a", count="n"))  # a hub's links are spread
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(joined.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of the component) for every node of ``edges`` (a, b)."""
    now = materialise(edges.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        now = materialise(_star(materialise(_star(now, True)), False))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
