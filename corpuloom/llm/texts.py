"""Compared texts of rows, each distinct text once, their windows, and exact verification of pairs.

Groups of exact copies are one class everywhere: candidates are searched between distinct texts
(:func:`distinct_texts`), and only a result that is defined on rows is spread to the members of a
class, by a join on the class key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuloom.functions.windows import chunks, compared, distinct_windows
from corpuloom.operators.sketches import SLOTS, assembled, log2_for, slots
from corpuloom.operators.skew import hot_keys, spread_join
from corpuloom.runtime import materialise, spread

TRAIN, EVAL = "train", ("val", "test")


def with_split(samples: DataFrame, registry: DataFrame) -> DataFrame:
    """id, split, source, question, cot of the rows whose source the registry knows; rows without id are left out."""
    splits = registry.where("source is not null").groupBy("source").agg(F.max("split").alias("split"))
    return samples.select("id", "source", "question", "cot").where("id is not null").join(splits, "source")


def compared_rows(df: DataFrame, keep: list[str], texts: list[str], least: int = 1) -> DataFrame:
    """``keep``, ``key`` (128-bit hash of the text), ``text``: the compared text of ``texts`` joined by newlines.

    Rows with fewer than ``least`` characters of compared text are dropped.
    """
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", key binary, text string"
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [b.column(k + i).to_pylist() for i in range(len(texts))]
            out = [compared("\n".join(x or "" for x in row)) for row in zip(*parts)]
            at = pa.array([i for i, t in enumerate(out) if len(t) >= least], pa.int64())
            rows = [t for t in out if len(t) >= least]
            keys = pa.array([xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(k)), keys, pa.array(rows, pa.string())], [*keep, "key", "text"])

    return df.select(*keep, *texts).mapInArrow(run, schema)


def distinct_texts(rows: DataFrame) -> DataFrame:
    """key, text, no: each distinct text once with a number of its own, written to the shared folder.

    Numbers stand for texts in all steps between, as they are half as long as keys.
    """
    once = rows.select("key", "text").dropDuplicates(["key"])  # partial aggregation before the shuffle
    return materialise(once.withColumn("no", F.monotonically_increasing_id()))


def window_sketch(texts: DataFrame, n: int):
    """Broadcast sketch of the windows of all texts and in how many of them each occurs."""
    log2 = log2_for(texts.agg(F.sum(F.length("text"))).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0).to_pylist()
            for i, j in chunks(rows, 2_000_000):  # counted per chunk before the shuffle
                yield slots(distinct_windows(rows[i:j], n)[1], log2)

    return assembled(texts.select("text").mapInArrow(run, SLOTS), log2)


def windows_in(texts: DataFrame, n: int, members) -> DataFrame:
    """no, h: the distinct windows of each text that the broadcast sketch may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = members.value
        for b in batches:
            rows = b.column(1).to_pylist()
            for i, j in chunks(rows, 300_000):
                owner, h = distinct_windows(rows[i:j], n)
                ok = wanted.has(h)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner[ok] + i)), pa.array(h[ok].view(np.int64))], ["no", "h"])

    return texts.select("no", "text").mapInArrow(run, "no bigint, h bigint")


def seeds_of(texts: DataFrame, n: int, members, share: float, hits: int) -> DataFrame:
    """no, h, t: of each text those of its windows of which any partner has ``t``, ``hits`` at most.

    A partner has ``need``, the part ``share``, of a text's windows, and so ``t`` of any ``size - need + t`` of
    them. The rarest ones by the broadcast sketch are taken; which ones are taken changes the time a join takes, never
    what is found. Windows that the sketch lacks are rarest of all, and need not be looked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = members.value
        for b in batches:
            rows = b.column(1).to_pylist()
            for i, j in chunks(rows, 300_000):
                owner, h = distinct_windows(rows[i:j], n)
                count = seen.of(h)
                size = np.bincount(owner, minlength=j - i)
                found = np.bincount(owner[count > 0], minlength=j - i)
                need = np.maximum(np.ceil(size * share - 1e-9).astype(np.int64), 1)
                t = np.minimum(hits, need)
                order = np.lexsort((h, count, owner))
                owner, h, count = owner[order], h[order], count[order]
                start = np.cumsum(size) - size
                place = np.arange(len(owner)) - start[owner]
                ok = (count > 0) & (found >= need)[owner] & (place < (size - need + t)[owner])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner[ok] + i)), pa.array(h[ok].view(np.int64)), pa.array(t[owner[ok]].astype(np.int32))], ["no", "h", "t"])

    return texts.select("no", "text").mapInArrow(run, "no bigint, h bigint, t int")


def similar_texts(pairs: DataFrame, a: DataFrame, b: DataFrame, n: int, least: float) -> DataFrame:
    """no_a, no_b, key_a, key_b, both, either of the pairs (no_a, no_b) of texts that reach the bound: counted exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, shared, union = [], [], []
            last, x = None, set()
            for k, (s, t) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                if s != last:
                    last, x = s, {s[i : i + n] for i in range(len(s) - n + 1)}
                y = {t[i : i + n] for i in range(len(t) - n + 1)}
                both = len(x & y)
                either = len(x) + len(y) - both
                if both and both >= least * either:
                    keep.append(k)
                    shared.append(both)
                    union.append(either)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(4)), pa.array(shared, pa.int32()), pa.array(union, pa.int32())], ["no_a", "no_b", "key_a", "key_b", "both", "either"])

    left, right = (t.select(F.col("no").alias(f"no_{x}"), F.col("key").alias(f"key_{x}"), F.col("text").alias(f"text_{x}")) for t, x in ((a, "a"), (b, "b")))
    both = spread_join(spread_join(pairs, right, "no_b", "no_a", hot_keys(pairs, "no_b")), left, "no_a", "no_b", hot_keys(pairs, "no_a"))
    return both.select("no_a", "no_b", "key_a", "key_b", "text_a", "text_b").mapInArrow(run, "no_a bigint, no_b bigint, key_a binary, key_b binary, both int, either int")


def train_and_eval(samples: DataFrame, registry: DataFrame, train_texts: list[str], eval_texts: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """(training rows, evaluation rows) with their compared texts, written once to the shared folder."""
    rows = with_split(spread(samples.select("id", "source", "question", "cot")), registry)
    train = materialise(compared_rows(rows.where(F.col("split") == TRAIN), ["id", "source"], train_texts))
    held = materialise(compared_rows(rows.where(F.col("split").isin(*EVAL)), ["id", "source", "split"], eval_texts, least))
    return train, held


def id_pairs(pairs: DataFrame, train: DataFrame, held: DataFrame) -> DataFrame:
    """id_a < id_b of all members of the classes in ``pairs`` (train_key, eval_key)."""
    a = train.select(F.col("key").alias("train_key"), F.col("id").alias("train_id")).distinct()
    b = held.select(F.col("key").alias("eval_key"), F.col("id").alias("eval_id")).distinct()
    met = spread_join(b, spread_join(a, pairs.select("train_key", "eval_key"), "train_key", "train_id"), "eval_key", "eval_id")
    return met.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))
