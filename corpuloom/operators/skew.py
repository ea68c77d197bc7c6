"""Joins and pairs on keys of which one may have a third of all rows.

Hot keys are those with more than ``block`` rows. Their rows are divided into blocks by a hash (the
same after a lost executor), so that no task holds more than a block of one key. The table of hot
keys has at most rows / block rows; whether it is broadcast is left to Spark, which checks its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuloom.runtime import materialise

BLOCK = 20_000


def hot_keys(rows: DataFrame, on: str, block: int | None = None, count: str | None = None) -> DataFrame:
    """``on``, blocks of the keys with more than ``block`` rows (``BLOCK``); ``count``: a column with the number of rows of each key, if known."""
    block = block or BLOCK
    counted = rows.select(on, F.col(count).alias("__n")) if count else rows.groupBy(on).agg(F.count(F.lit(1)).alias("__n"))
    # written, so that its size is known when a join with it is planned
    return materialise(counted.where(F.col("__n") > block).select(on, F.ceil(F.col("__n") / F.lit(block)).cast("int").alias("__blocks")))


def spread_join(many: DataFrame, few: DataFrame, on: str, by: str, hot: DataFrame | None = None, block: int | None = None, how: str = "inner") -> DataFrame:
    """``many`` joined (inner or left) with ``few`` on ``on``; a hot key's rows of ``many`` are spread by a hash of ``by``, its rows of ``few`` repeated for each block.

    Rows of ``many`` without key, which a left join keeps, are spread, too.
    """
    hot = hot if hot is not None else hot_keys(many, on, block)
    salt = F.when(F.col(on).isNull(), F.pmod(F.xxhash64(by), F.lit(997))).otherwise(F.coalesce(F.pmod(F.xxhash64(by), F.col("__blocks")), F.lit(0)))
    salted = many.join(hot.where(F.col(on).isNotNull()), on, "left").withColumn("__salt", salt.cast("int")).drop("__blocks")
    repeated = few.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__blocks"), F.lit(1)) - 1))).drop("__blocks")
    return salted.join(repeated, [on, "__salt"], how).drop("__salt")


def pairs_within(rows: DataFrame, group: str, item: str, size: str, block: int = 1_000) -> DataFrame:
    """a < b: all pairs of items of each group; ``size``: the number of rows of a row's group.

    Groups of more than ``block`` rows are divided into blocks, and every pair of blocks meets in a
    task of its own. A group's pairs are its result; for groups of equal texts take one
    representative, so that only texts that differ meet.
    """
    placed = rows.where(F.col(size) > 1).select(group, F.col(item).alias("__item"), F.ceil(F.col(size) / F.lit(block)).cast("int").alias("__blocks"))
    placed = placed.withColumn("__block", F.pmod(F.xxhash64("__item"), F.col("__blocks")).cast("int"))

    def side(name: str, i: Column, j: Column, span: Column) -> DataFrame:
        return placed.select(group, F.col("__item").alias(name), i.alias("__i") if i is not None else F.explode(span).alias("__i"), j.alias("__j") if j is not None else F.explode(span).alias("__j"))

    # each item meets its own block and, from the left, all later ones
    left = side("a", F.col("__block"), None, F.sequence(F.col("__block"), F.col("__blocks") - 1))
    right = side("b", None, F.col("__block"), F.sequence(F.lit(0), F.col("__block")))
    met = left.join(right, [group, "__i", "__j"]).where((F.col("a") < F.col("b")) | (F.col("__i") != F.col("__j")) & (F.col("a") != F.col("b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
