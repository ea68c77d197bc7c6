"""Positions in an order over all rows, or over the rows of each group, without a task that holds them all.

*Hash orders* are divided by the first digits of the hash: ranges of a known number, of about equal size
whatever the data. *Value orders* are divided by a range shuffle. Either way the rows of every range are counted
first (one row per range), and rows are numbered inside their range only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpuloom.runtime import materialise

#: Hexadecimal digits that divide a hash order: 65,536 ranges.
DIGITS = 4


def _before(counts: DataFrame, by: list[str], part: str) -> DataFrame:
    """``counts`` (by, part, __n) with the rows of all parts before (``__before``): one row per part."""
    order = W.partitionBy(*(by or [F.lit(1)])).orderBy(part)
    return counts.withColumn("__before", F.sum("__n").over(order) - F.col("__n"))


def by_hash(df: DataFrame, hashed: Column, key: str, start: int, stop: int, by: list[str] | None = None) -> DataFrame:
    """The rows at positions ``start`` to ``stop`` - 1 of the order of a hexadecimal hash (ties: ``key``), of each group ``by``, with ``pos``."""
    by = by or []
    rows = df.withColumn("__h", hashed).withColumn("__part", F.left("__h", F.lit(DIGITS)))
    parts = _before(rows.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n")), by, "__part")
    wanted = parts.where((F.col("__before") < stop) & (F.col("__before") + F.col("__n") > start)).drop("__n")
    same = F.lit(True)
    for c in [*by, "__part"]:  # groups may be null
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}"))
    met = rows.alias("r").join(wanted.alias("p"), same).select("r.*", "p.__before")
    inside = W.partitionBy(*by, "__part").orderBy("__h", key)
    placed = met.withColumn("pos", F.col("__before") + F.row_number().over(inside) - 1)
    return placed.where((F.col("pos") >= start) & (F.col("pos") < stop)).drop("__h", "__part", "__before")


def numbered(df: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """``df`` with ``pos`` from 0 in an order of values, of each group ``by``. The order must leave no ties."""
    by = by or []
    sort = [*(F.col(c) for c in by), *order]
    ranged = materialise(df.repartitionByRange(*sort).withColumn("__part", F.spark_partition_id()))
    parts = _before(ranged.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n")), by, "__part").drop("__n")
    same = F.lit(True)
    for c in [*by, "__part"]:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}"))
    met = ranged.alias("r").join(parts.alias("p"), same).select("r.*", "p.__before")
    return met.withColumn("pos", F.col("__before") + F.row_number().over(W.partitionBy(*by, "__part").orderBy(*order)) - 1).drop("__part", "__before")


def at_ranks(df: DataFrame, value: str, ranks: dict[str, Column], by: list[str]) -> DataFrame:
    """``by`` and a column per rank: the value at that position (from 0, by the group's number of values ``__all``) of the sorted values that are not null.

    Equal values are counted together first; of the ranges only those that hold a rank are looked into.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranged = materialise(counts.repartitionByRange(*by, "__v").withColumn("__part", F.spark_partition_id()))
    parts = _before(ranged.groupBy(*by, "__part").agg(F.sum("__n").alias("__n")), by, "__part").withColumn("__all", F.sum("__n").over(W.partitionBy(*by)))
    targets = F.array(*(F.least(F.col("__all") - 1, r).cast("bigint") for r in ranks.values()))
    wanted = parts.withColumn("__at", targets).where(F.exists("__at", lambda a: (a >= F.col("__before")) & (a < F.col("__before") + F.col("__n")))).drop("__n", "__all")
    same = F.lit(True)
    for c in [*by, "__part"]:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}"))
    met = ranged.alias("r").join(wanted.alias("p"), same).select("r.*", "p.__before", "p.__at")
    upto = met.withColumn("__end", F.col("__before") + F.sum("__n").over(W.partitionBy(*by, "__part").orderBy("__v")))
    hit = [F.max(F.when((F.col("__at")[k] < F.col("__end")) & (F.col("__at")[k] >= F.col("__end") - F.col("__n")), F.col("__v"))).alias(name) for k, name in enumerate(ranks)]
    return upto.groupBy(*by).agg(*hit)
