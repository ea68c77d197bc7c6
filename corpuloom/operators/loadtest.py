"""Load-test summaries of recorded requests: percentiles, throughput, comparison of two series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuloom.functions.stats import time_per_token
from corpuloom.operators.ranks import at_ranks


def requests_at(concurrency: Column) -> Column:
    """Requests sent at a level of concurrency."""
    return F.greatest(concurrency * 3, F.lit(12))


def percentiles(requests: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """``by`` and a column per share: the element int(n * share) of the sorted values, from 0, the last one at most.

    Equal values are counted together, and the sorted values are divided by a range shuffle: no task holds a level.
    """
    return at_ranks(requests, value, {name: F.floor(F.col("__all") * F.lit(q)) for name, q in shares.items()}, by)


def levels(requests: DataFrame, by: list[str], wall: str = "wall_s") -> DataFrame:
    """Per level: requests, failed, percentiles of first-token time and time per token of good requests, tokens and requests a second.

    ``requests``: ttft_ms, total_ms, out_tokens, ok, and the wall time of the level. A level without good requests has no figures.
    """
    timed = requests.withColumn("tpot_ms", time_per_token(F.col("total_ms"), F.col("ttft_ms"), F.col("out_tokens")))
    good = timed.where("ok")
    counts = requests.groupBy(*by).agg(F.count_if("ok").alias("requests"), F.count_if(~F.col("ok")).alias("failed"), F.max(wall).alias("wall_s"), F.sum(F.when(F.col("ok"), F.col("out_tokens"))).alias("__tokens"))
    first = percentiles(good, "ttft_ms", {"ttft_p50": 0.5, "ttft_p95": 0.95}, by)
    per = percentiles(good, "tpot_ms", {"tpot_p50": 0.5, "tpot_p95": 0.95}, by)
    rate = counts.withColumn("output_tok_s", F.when(F.col("requests") > 0, F.col("__tokens") / F.col("wall_s"))).withColumn("req_per_s", F.when(F.col("requests") > 0, F.col("requests") / F.col("wall_s")))
    return rate.join(first, by, "left").join(per, by, "left").select(*by, "requests", "failed", "ttft_p50", "ttft_p95", "tpot_p50", "tpot_p95", "output_tok_s", "req_per_s", "wall_s")


def peaks(summary: DataFrame, series: str = "label") -> DataFrame:
    """Peak throughput of each series; levels without figures count as 0."""
    return summary.groupBy(series).agg(F.max(F.coalesce("output_tok_s", F.lit(0.0))).alias("peak"))


def gain(summary: DataFrame, before: str, after: str, series: str = "label") -> DataFrame:
    """peak_before, peak_after and the gain in per cent between two series."""
    p = peaks(summary, series).agg(F.max(F.when(F.col(series) == before, F.col("peak"))).alias("peak_before"), F.max(F.when(F.col(series) == after, F.col("peak"))).alias("peak_after"))
    return p.withColumn("gain", F.when(F.col("peak_before") > 0, (F.col("peak_after") / F.col("peak_before") - 1) * 100))


def bench_record(summary: DataFrame, label: str, model: str, gpu: str, max_tokens: int) -> DataFrame:
    """One row (``record``): the JSON of a load test with its levels by concurrency; a test has few levels."""
    level = ("concurrency", "requests", "failed", "ttft_p50", "ttft_p95", "tpot_p50", "tpot_p95", "output_tok_s", "req_per_s", "wall_s")
    levels = F.array_sort(F.collect_list(F.struct(*level))).alias("levels")
    named = summary.agg(levels).select(F.lit(label).alias("label"), F.lit(model).alias("model"), F.lit(gpu).alias("gpu"), F.lit(max_tokens).cast("bigint").alias("max_tokens"), "levels")
    return named.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
