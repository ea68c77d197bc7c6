"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def share(part: Column, whole: Column) -> Column:
    """part / whole; 0 where there is nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson interval of k successes in n trials, within [0, 1]; (0, 0) without trials."""
    p, m = k.cast("double") / n, n.cast("double")
    denominator = F.lit(1.0) + F.lit(Z * Z) / m
    centre = (p + F.lit(Z * Z) / (F.lit(2.0) * m)) / denominator
    half = F.lit(Z) * F.sqrt(p * (F.lit(1.0) - p) / m + F.lit(Z * Z) / (F.lit(4.0) * m * m)) / denominator
    none = F.lit(0.0)
    return F.when(n > 0, F.greatest(none, centre - half)).otherwise(none), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(none)


def time_per_token(total_ms: Column, first_ms: Column, tokens: Column) -> Column:
    """Milliseconds per token after the first; a missing first-token time is the total."""
    return (total_ms - F.coalesce(first_ms, total_ms)) / F.greatest(F.lit(1), tokens - 1)


def nice_max(value: Column) -> Column:
    """The value rounded up to one significant digit (axis ends)."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    return F.when(value > 0, F.ceil(value / power) * power).otherwise(F.lit(0.0))


def verdict_name(correct: Column) -> Column:
    """Name of a three-valued verdict."""
    return F.when(correct.isNull(), "abstain").when(correct, "correct").otherwise("wrong")


def short_count(n: Column) -> Column:
    """A count in thousands from 1000 on, one digit after the point."""
    return F.when(n >= 1000, F.concat(F.format_number(n / 1000, 1), F.lit("k"))).otherwise(n.cast("string"))
