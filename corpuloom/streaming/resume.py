"""Resumable work: what a checkpoint already holds is not done again.

A long job that asks an external service writes each answer to an append-only table. On restart the
rest is the anti join against it. ``follow`` does the same for files that keep arriving: Structured
Streaming tracks the files, and every micro-batch appends the rows whose key is not there yet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def remaining(work: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return work.join(done.select(key).distinct(), key, "left_anti")


def bounded(work: DataFrame, at_once: int) -> DataFrame:
    """As many partitions as requests may be open at once."""
    return work.repartition(at_once)


def follow(spark: SparkSession, path: str, schema: str, key: str, target: str, state: str, work: Callable[[DataFrame], DataFrame], **trigger) -> StreamingQuery:
    """Run ``work`` on new JSON lines under ``path`` and append its rows to the Parquet table ``target``."""

    def step(batch: DataFrame, _: int) -> None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        fresh = batch.dropDuplicates([key])
        todo = remaining(fresh, spark.read.parquet(target), key) if there else fresh
        work(todo).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).json(path)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(**(trigger or {"availableNow": True})).start()
