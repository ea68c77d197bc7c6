"""Sampling and mixing that do not depend on partitioning.

Native sampling ranks rows by a seeded hash of their key: prefix-stable (a smaller sample is the
beginning of a larger one), shardable by slices of the order, and the same in SQL. Compatible
sampling draws row numbers with the seeded generator of Python's ``random`` on the driver, for
exact agreement with samples drawn that way; it needs contiguous ordinals.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuloom.operators.ranks import by_hash

SEED = 42


def hash_order(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def sample(df: DataFrame, key: str, n: int, seed: int = SEED, offset: int = 0, by: list[str] | None = None) -> DataFrame:
    """``n`` rows from position ``offset`` of the hash order (per stratum ``by``), with their ``pos`` from 0.

    The hash order is divided into ranges, of which only those that hold the positions are sorted, each by itself.
    """
    return by_hash(df, hash_order(F.col(key), seed), key, offset, offset + n, by)


def compat_sample(df: DataFrame, ord_col: str, n: int, k: int, seed: int = SEED, rng: random.Random | None = None) -> DataFrame:
    """The rows ``Random(seed).sample(range(n), min(k, n))`` in that order, as ``pos``."""
    drawn = (rng or random.Random(seed)).sample(range(n), min(k, n))
    places = df.sparkSession.createDataFrame([(o, p) for p, o in enumerate(drawn)] or [(-1, -1)], f"`{ord_col}` bigint, pos bigint")
    return df.join(places, ord_col)


def general_rows_needed(main_rows: int, ratio: float) -> int:
    """How many general rows make up ``ratio`` of the mix."""
    return int(main_rows * ratio / (1 - ratio))


def ratio_mix(main: DataFrame, general: DataFrame, key: str, ratio: float, seed: int = SEED) -> DataFrame:
    """All of ``main`` and so much of ``general`` that it is ``ratio`` of the whole, in hash order (``shuffle_key``)."""
    need = general_rows_needed(main.count(), ratio)
    there = general.count()
    if there < need:
        raise ValueError(f"{need} general rows needed, {there} there")
    chosen = sample(general, key, need, seed).drop("pos")
    both = main.withColumn("origin", F.lit("main")).unionByName(chosen.withColumn("origin", F.lit("general")))
    return both.withColumn("shuffle_key", hash_order(F.concat(F.col("origin"), F.lit(":"), F.col(key)), seed))


def composition(mixed: DataFrame) -> DataFrame:
    """origin, rows, share of a mix."""
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # rows: one per origin
    return mixed.groupBy("origin").agg(F.count(F.lit(1)).alias("rows")).withColumn("share", F.col("rows") / F.sum("rows").over(every))


def round_robin(prompts: DataFrame, n: int, ord_col: str = "ord") -> DataFrame:
    """Request numbers 0 to n - 1 (``i``) with prompts in turn; ``prompts`` has contiguous ordinals."""
    count = prompts.count()
    numbers = prompts.sparkSession.range(n).select(F.col("id").alias("i"), F.pmod("id", F.lit(max(count, 1))).alias(ord_col))
    return numbers.join(prompts, ord_col)


def parse_sizes(text: str) -> dict[str, int]:
    """``name=n,name=n`` to a dictionary."""
    return {name.strip(): int(n) for name, _, n in (part.partition("=") for part in text.split(",") if part.strip())}


def head(df: DataFrame, n: int, order: str = "ord", **chosen: str) -> DataFrame:
    """The rows with the first ``n`` numbers of a contiguous order, of those that have the given values."""
    for name, value in chosen.items():
        df = df.where(F.col(name) == value)
    return df.where(F.col(order) < n)
