"""Positions in orders, against sorting on the driver."""

import random

import pytest
from pyspark.sql import functions as F

from corpuloom.operators import ranks as R
from corpuloom.operators import sampling as S


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(3)
    data = [(f"k{i}", random.choice(["a", "b", None]) if i % 3 else "a", random.choice([1.0, 2.5, -3.0, float(i), None])) for i in range(500)]
    return data, spark.createDataFrame(data, "k string, g string, v double").repartition(5)


def order(key):
    import hashlib

    return hashlib.md5(f"42:{key}".encode()).hexdigest(), key


def test_hash_order(rows):
    data, df = rows
    want = sorted((r[0] for r in data), key=order)
    for start, n in ((0, 7), (100, 50), (490, 50), (600, 5), (0, 0)):
        got = {r["pos"]: r["k"] for r in S.sample(df, "k", n, offset=start).collect()}
        assert got == {start + i: k for i, k in enumerate(want[start : start + n])}
    per = {}
    for k in want:
        per.setdefault(next(g for kk, g, _ in data if kk == k), []).append(k)
    got = {(r["g"], r["pos"]): r["k"] for r in S.sample(df, "k", 20, offset=5, by=["g"]).collect()}
    assert got == {(g, i): k for g, ks in per.items() for i, k in enumerate(ks) if 5 <= i < 25}


def test_numbered(rows):
    data, df = rows
    got = sorted((r["pos"], r["k"]) for r in R.numbered(df, [F.desc("k")]).collect())
    assert got == list(enumerate(sorted((r[0] for r in data), reverse=True)))
    got = {(r["g"], r["pos"]): r["k"] for r in R.numbered(df, [F.col("k")], ["g"]).collect()}
    assert got == {(g, i): k for g in ("a", "b", None) for i, k in enumerate(sorted(r[0] for r in data if r[1] == g))}
    assert R.numbered(df.limit(0), [F.col("k")]).count() == 0


def test_ranks_with_ties(rows):
    data, df = rows
    got = {r["g"]: (r["p"], r["q"]) for r in R.at_ranks(df, "v", {"p": F.floor(F.col("__all") * 0.5), "q": F.lit(10**6)}, ["g"]).collect()}
    want = {}
    for g in ("a", "b", None):
        v = sorted(r[2] for r in data if r[1] == g and r[2] is not None)
        want[g] = (v[len(v) // 2], v[-1])
    assert got == want


def test_mixes_and_heads(spark):
    main, general = spark.range(85).select(F.concat(F.lit("m"), "id").alias("k")), spark.range(50).select(F.concat(F.lit("g"), "id").alias("k"))
    mixed = S.ratio_mix(main, general, "k", 0.15)
    assert {r["origin"]: (r["rows"], round(r["share"], 3)) for r in S.composition(mixed).collect()} == {"main": (85, 0.85), "general": (15, 0.15)}
    items = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x"), (3, "x")], "ord int, set_name string")
    assert [r["ord"] for r in S.head(items, 3, set_name="x").orderBy("ord").collect()] == [0, 2]
