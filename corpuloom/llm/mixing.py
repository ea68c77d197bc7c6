"""Problem 9: mix sources to target weights, sizes in tokens of a public tokenizer.

Every document gets a hash-random key. Within each source the documents are ordered by that key in
ranges: a source of n rows has about n / ``ROWS_PER_RANGE`` ranges, equally likely for every key, so
that no range, and no task, holds more however large the source is. Prefix sums of tokens are taken
over ranges first (one row per range) and then inside each range. A source's budget is its share of
the mix; it is filled by whole epochs and by the documents of the next epoch up to the prefix sum
nearest to the rest of the budget, never beyond ``max_repeats`` uses of a document.

The mix is as large as it can be with every share met (``total_tokens=None``), or of a given size;
then a source that cannot reach its share within ``max_repeats`` is used as often as allowed.

Defined results: documents without a source, with a source without target, or with a null text take
no part; empty texts have no tokens and are used as often as their place says. Sources of the
target table without any token get no documents and an actual share of 0, and do not limit the mix.
A target without share or repeats counts as 0. Duplicate target rows of a source count once (the
largest share). Repeated documents are separate documents. Ties of keys are ordered by id. Empty
tables give an empty mix and actual shares of 0. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from corpuloom.llm.tokens import count_tokens
from corpuloom.runtime import materialise

ROWS_PER_RANGE = 20_000


def _plan(docs: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """One row per target source: what it has, its budget, full epochs and the rest."""
    goal = targets.groupBy("source").agg(
        F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).cast("bigint").alias("max_repeats")
    )
    have = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("have"))
    plan = goal.join(have, "source", "left").fillna(0, ["n_docs", "have"])
    every = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # rows: one per target
    if total_tokens is None:
        reach = F.when((F.col("target_share") > 0) & (F.col("have") > 0), F.col("have") * F.col("max_repeats") / F.col("target_share"))
        plan = plan.withColumn("total", F.coalesce(F.min(reach).over(every), F.lit(0.0)))
    else:
        plan = plan.withColumn("total", F.lit(float(total_tokens)))
    budget = F.least(F.col("total") * F.col("target_share"), (F.col("have") * F.col("max_repeats")).cast("double"))
    # a budget that is the whole of the allowed epochs but for rounding is whole
    return (
        plan.withColumn("budget", F.round(budget, 3))
        .withColumn("epochs", F.when(F.col("have") > 0, F.least(F.floor(F.col("budget") / F.col("have")), F.col("max_repeats"))).otherwise(F.lit(0)))
        .withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("have")).otherwise(F.lit(0.0)))
    )


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(mixed, shares)``.

    ``mixed``: doc_id, source, n_tokens, copies (at least 1) of the documents in the mix.
    ``shares``: source, target_share, actual_share, docs, copies, tokens, max_repeats, one row per target.
    """
    targets = targets.select("source", "target_share", "max_repeats").where(F.col("source").isNotNull())
    wanted = documents.select("doc_id", "source", "text").where(F.col("text").isNotNull() & F.col("source").isNotNull())
    docs = materialise(
        count_tokens(wanted, vocabulary=vocabulary)
        .join(targets.select("source").distinct(), "source", "left_semi")
        .withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    )
    plan = _plan(docs, targets, total_tokens)
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(ROWS_PER_RANGE)))
    # the upper 31 bits of the key, as a fraction of the source's ranges
    placed = docs.join(plan.select("source", "n_docs", "epochs", "rest"), "source").withColumn(
        "range", F.floor((F.shiftrightunsigned("key", 33) * ranges) / F.lit(float(1 << 31))).cast("bigint")
    )
    sums = placed.groupBy("source", "range").agg(F.sum("n_tokens").alias("sum"))
    before = sums.select("source", "range", (F.sum("sum").over(W.partitionBy("source").orderBy("range")) - F.col("sum")).alias("before"))
    inside = W.partitionBy("source", "range").orderBy(F.shiftrightunsigned("key", 1), "key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    summed = placed.join(before, ["source", "range"]).withColumn("prefix", F.col("before") + F.sum("n_tokens").over(inside))
    # the cut nearest to the rest: a document is in when at least half of it is
    extra = ((F.col("prefix") - F.col("n_tokens") / 2.0) <= F.col("rest")) & (F.col("rest") > 0)
    mixed = summed.select("doc_id", "source", "n_tokens", (F.col("epochs") + F.when(extra, 1).otherwise(0)).cast("bigint").alias("copies")).where("copies > 0")
    used = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    every = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # rows: one per target
    shares = (
        plan.select("source", "target_share", "max_repeats")
        .join(used, "source", "left")
        .fillna(0, ["docs", "copies", "tokens"])
        .withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(every)), F.lit(0.0)).cast("double"))
        .select("source", "target_share", "actual_share", "docs", "copies", "tokens", "max_repeats")
    )
    return mixed, shares
