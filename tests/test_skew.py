"""Joins, pairs and sketches on data of which one key has a third."""

import numpy as np
from pyspark.sql import functions as F

from corpuloom.operators.sketches import frequent, sketch
from corpuloom.operators.skew import pairs_within, spread_join


def rows(spark):
    """3,000 rows, of which a third have key 0; some keys are null, some rows come twice."""
    return spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 50 + 1).alias("k"), (F.col("id") - F.col("id") % 7 % 2).alias("v"))


def test_spread_join(spark):
    many, few = rows(spark), spark.createDataFrame([(0, "a"), (0, "b"), (3, "c"), (None, "n"), (999, "z")], "k bigint, w string")
    plain = sorted(map(repr, many.join(few, "k").select("k", "v", "w").collect()))
    assert sorted(map(repr, spread_join(many, few, "k", "v", block=100).select("k", "v", "w").collect())) == plain
    assert sorted(map(repr, spread_join(many, few, "k", "v", block=10**9).select("k", "v", "w").collect())) == plain
    kept = sorted(map(repr, many.join(few, "k", "left").select("k", "v", "w").collect()))
    assert sorted(map(repr, spread_join(many, few, "k", "v", block=100, how="left").select("k", "v", "w").collect())) == kept
    assert spread_join(many.limit(0), few, "k", "v").count() == 0


def test_pairs_within(spark):
    items = [("hot", i) for i in range(100)] + [("b", 1), ("b", 5), ("c", 9)]
    df = spark.createDataFrame(items, "g string, x int")
    sized = df.join(df.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g")
    want = sorted([(i, j) for i in range(100) for j in range(i + 1, 100)] + [(1, 5)])
    for block in (7, 1000):
        assert sorted(tuple(r) for r in pairs_within(sized, "g", "x", "n", block).collect()) == want


def test_sketch(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64)
    df = spark.createDataFrame([(int(x), int(i % 300 + 1)) for i, x in enumerate(h)], "h bigint, n bigint")
    s = sketch(df, 5000).value
    assert (s.of(h.view(np.uint64)) >= np.minimum(np.arange(5000) % 300 + 1, 255)).all()
    often = {r["h"] for r in frequent(df, sketch(df, 5000), 100).collect()}
    assert often >= {int(x) for i, x in enumerate(h) if i % 300 + 1 >= 100} and len(often) < 4000
    others = rng.integers(0, 1 << 64, 20000, dtype=np.uint64)
    assert s.has(others).mean() < 0.1
    assert not sketch(df.limit(0), 0).value.has(others).any()
    assert sketch(df.select("h"), 5000, most_log2=16).value.has(h.view(np.uint64)).all()  # a full one passes more, never less
