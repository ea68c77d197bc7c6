"""Sources and sinks: JSON lines, JSON documents, checkpoints, reports, settings.

All readers take explicit schemas. Files that have an order keep it in an ``ord`` column, counted
over all files from 0 without gaps.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuloom.runtime import materialise

SAMPLE = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("question", T.StringType()), T.StructField("gold", T.StringType()),
        T.StructField("options", T.MapType(T.StringType(), T.StringType())), T.StructField("cot", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """ord, line: the lines of text files in file order; blank lines count and stay.

    Stays in the JVM: every split of a file knows its first row number, and a table of splits with their numbers of
    lines gives where each begins.
    """
    split = ["__file", "__start"]
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"))
    sizes = lines.groupBy(*split).agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    order = W.partitionBy(F.lit(1)).orderBy(*split)  # rows: one per split
    begins = sizes.select(*split, "__first", (F.sum("__n").over(order) - F.col("__n")).alias("__before"))
    return lines.join(begins, split).select((F.col("__before") + F.col("__id") - F.col("__first")).alias("ord"), "line")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, skip_blank: bool = True) -> DataFrame:
    """ord and the fields of ``schema`` of each line."""
    lines = read_lines(spark, path)
    if skip_blank:
        lines = lines.where(F.trim("line") != "")
    return lines.select("ord", F.from_json("line", schema).alias("row")).select("ord", "row.*")


def read_json_documents(spark: SparkSession, glob: str, schema: T.StructType | str) -> DataFrame:
    """Whole-file JSON documents (an object, or a list of objects) with their ``file`` name."""
    return spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def missing_fields(lines: DataFrame, required: list[str], line: str = "line") -> DataFrame:
    """ord, missing: lines that lack required keys (fail-fast on schema: callers raise when there are any)."""
    keys = F.coalesce(F.json_object_keys(line), F.array().cast("array<string>"))
    lacking = F.array_except(F.array(*map(F.lit, required)), keys)
    return lines.select("ord", lacking.alias("missing")).where(F.size("missing") > 0)


def require(df: DataFrame, *names: str) -> DataFrame:
    """``df`` if it has all columns; else a KeyError that names what is missing and what is there."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing fields {missing}; there are {sorted(df.columns)[:20]}")
    return df


def last_wins(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The last row of each key."""
    newest = W.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def write_jsonl(df: DataFrame, path: str, order: str | None = None) -> None:
    """JSON lines, nulls written; with ``order`` the files' rows follow it."""
    out = df.repartitionByRange(order).sortWithinPartitions(order).drop(order) if order else df
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_checkpoint(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def rewrite(df: DataFrame, path: str) -> None:
    """Replace JSON lines by ``df``, which may have been read from there: it is written to the shared folder before."""
    materialise(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_scored(spark: SparkSession, path: str) -> DataFrame:
    """id, correct, method of scored lines; a verdict that is null or missing is an abstention."""
    return read_jsonl(spark, path, "id string, correct boolean, method string").drop("ord")


def load_human_labels(spark: SparkSession, path: str) -> DataFrame:
    """The sample's fields, output and human_correct of labelled lines."""
    nested = T.StructType([T.StructField("sample", SAMPLE), T.StructField("output", T.StringType()), T.StructField("human_correct", T.BooleanType())])
    return read_jsonl(spark, path, nested).select("sample.*", "output", "human_correct")


def write_report(path: str, text: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def fetch_all(names: list[str], known: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(frames, errors): each named source on its own; one that fails does not stop the others.

    An unknown name is a KeyError before anything is read.
    """
    unknown = [n for n in names if n not in known]
    if unknown:
        raise KeyError(f"unknown sources {unknown}; known are {sorted(known)}")
    frames, errors = {}, {}
    for n in names:
        try:
            frames[n] = known[n]()
        except Exception as e:
            errors[n] = f"{type(e).__name__}: {e}"
    return frames, errors


def load_env(path: str) -> dict[str, str]:
    """KEY=VALUE lines into the environment; blank lines, comments and lines without value are skipped, set variables stay."""
    read: dict[str, str] = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines() if Path(path).exists() else []:
        name, sign, value = line.strip().partition("=")
        name, value = name.strip(), value.strip()
        if sign and name and value and not name.startswith("#"):
            read[name] = value
            os.environ.setdefault(name, value)
    return read


def gate(passed: bool, message: str) -> None:
    """A quality gate: raises where a command line would exit with an error."""
    if not passed:
        raise AssertionError(message)
