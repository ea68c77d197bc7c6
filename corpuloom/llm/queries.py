"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuloom.llm import answers, leakage, mixing, neardup, overlap, repetition, tokens, toxicity
from corpuloom.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _samples(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "samples"), table(spark, d, "source_registry")


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find(*_samples(spark, d))


@query
def p1_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.items(*_samples(spark, d))


@query
def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.clean(*_samples(spark, d))


@query
def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return leakage.redact(*_samples(spark, d))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeated(table(spark, d, "outputs")).select("out_id")


@query
def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.shares(table(spark, d, "outputs"))


def _answered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "outputs"), table(spark, d, "dpo_samples"), table(spark, d, "samples")


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.defects(*_answered(spark, d)).select("origin", "rec_id", "pos", "defect")


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.truncated(*_answered(spark, d)).select("origin", "rec_id", "pos")


@query
def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return answers.truncation_rates(*_answered(spark, d))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.find(*_samples(spark, d))


@query
def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(*_samples(spark, d))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.find(*_samples(spark, d))


@query
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(*_samples(spark, d))


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


@query
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.find(table(spark, d, "documents"), table(spark, d, "tox_labels"))


@query
def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, d, "tox_labels")))


@query
def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(table(spark, d, "documents"), table(spark, d, "tox_labels"))
