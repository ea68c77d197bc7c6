"""Problem 4: near-duplicate records with small edits.

Two training rows are near-duplicates when the windows of 5 of ``question``, newline, ``cot`` found
in both are at least 0.6 of those found in either.

1. Each distinct text gets MinHash values of its windows: ``BANDS * ROWS`` values grouped into bands
   for candidates, and ``CHECKS`` further values of one byte for verification.
2. Texts that share a band's values are candidates. A broadcast sketch of bounded size counts how often each value
   occurs; values that occur once, nearly all, are neither shuffled nor joined. Buckets of more than ``BLOCK`` texts are divided into blocks, and pairs of blocks are
   spread over tasks, so that no task holds a whole hot bucket.
3. Candidates are verified sequentially: signatures are compared in batches of ``BATCH`` values;
   after each batch the posterior probability that the similarity reaches the bound is computed
   from the matches so far (uniform prior on the collision probability), and pairs below the chosen
   miss probability are pruned.
4. Survivors are verified exactly on the texts.

With 40 bands of 3 values a pair at similarity 0.6 is missed with probability 6e-5 (at 0.65:
3e-6), and each Bayesian batch adds at most ``MISS``. Rows with equal texts are one text throughout; only the
list of pairs expands them, in blocks.

Defined results: null texts count as empty; texts of fewer than 5 characters of compared text have
no window and no partner; rows with a null id or an unknown source take no part; rows delivered
twice count once; rows with equal texts are pairs of similarity 1. Empty tables give no rows. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuloom.functions.windows import chunks, distinct_windows, mix64
from corpuloom.llm.components import components
from corpuloom.llm.texts import TRAIN, compared_rows, distinct_texts, similar_texts, with_split
from corpuloom.operators.sketches import SLOTS, assembled, log2_for, slots
from corpuloom.operators.skew import hot_keys, pairs_within, spread_join
from corpuloom.runtime import materialise, spread

N = 5
SIMILARITY = 0.6
BANDS, ROWS = 40, 3
CHECKS, BATCH = 128, 32
MISS = 1e-5
BLOCK = 1_000


@functools.lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 1 << 63, size=BANDS * ROWS + CHECKS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(band hashes, check bytes) of texts with at least one window each.

    Window hashes are mixed already, so that an odd multiplier gives another order of them.
    """
    owner, h = distinct_windows(texts, N)
    start = np.searchsorted(owner, np.arange(len(texts)))
    mult = _multipliers()
    mins = np.empty((len(mult), len(texts)), np.uint64)
    x = np.empty_like(h)
    with np.errstate(over="ignore"):
        for k, a in enumerate(mult):
            np.multiply(h, a, out=x)
            mins[k] = np.minimum.reduceat(x, start)
        bands = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(texts), axis=1)
        for r in range(ROWS):
            bands = mix64(bands * np.uint64(0x9E3779B97F4A7C15) + mins[: BANDS * ROWS].reshape(BANDS, ROWS, -1)[:, r])
        check = (mins[BANDS * ROWS :] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8)
    return bands.T.copy(), check.T.copy()


def _at_least(p: float, matches: int, n: int) -> float:
    """Posterior probability of a collision probability of p or more, uniform prior: a binomial tail."""
    # I_p(m+1, n-m+1) complement = P(Binomial(n+1, p) <= m)
    return sum(math.comb(n + 1, k) * p**k * (1 - p) ** (n + 1 - k) for k in range(matches + 1))


@functools.lru_cache(maxsize=8)
def least_matches(similarity: float, miss: float = MISS) -> tuple[int, ...]:
    """After each batch, the fewest matches with which a pair stays."""
    p = similarity + (1 - similarity) / 256  # one-byte values collide by chance, too
    return tuple(next(m for m in range(n + 1) if _at_least(p, m, n) >= miss) for n in range(BATCH, CHECKS + 1, BATCH))


def _signed(texts: DataFrame) -> DataFrame:
    """no, check, bands of the distinct texts; a band's hash is of its values and its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(1).to_pylist()
            for i, j in chunks(rows, 100_000):
                bands, check = signatures(rows[i:j])
                m = j - i
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, m), pa.array([x.tobytes() for x in check], pa.binary()), lists], ["no", "check", "bands"])

    return texts.select("no", "text").where(F.length("text") >= N).mapInArrow(run, "no bigint, check binary, bands array<bigint>")


def _candidates(signed: DataFrame) -> DataFrame:
    """no_a < no_b of texts that share a band, each pair once."""
    log2 = log2_for(signed.count() * BANDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield slots(b.column(0).flatten().to_numpy(), log2)

    members = assembled(signed.select("bands").mapInArrow(count, SLOTS), log2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = members.value
        for b in batches:
            h = b.column(1).flatten().to_numpy()
            at = np.flatnonzero(counts.of(h) > 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at // BANDS)), pa.array(h[at])], ["no", "h"])

    entries = materialise(signed.select("no", "bands").mapInArrow(run, "no bigint, h bigint"))
    sizes = materialise(entries.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = spread_join(entries, sizes, "h", "no", hot_keys(sizes, "h", count="n"))
    met = pairs_within(shared, "h", "no", "n", BLOCK)
    return met.select(F.col("a").alias("no_a"), F.col("b").alias("no_b")).distinct()


def _prune(pairs: DataFrame, similarity: float) -> DataFrame:
    least = least_matches(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, CHECKS) for k in (2, 3))
            alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
            for k, m in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (a[alive, part] == c[alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= m]
            at = pa.array(alive)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["no_a", "no_b"])

    return pairs.select("no_a", "no_b", "check_a", "check_b").mapInArrow(run, "no_a bigint, no_b bigint")


def similar_classes(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """key_a, key_b, similarity: pairs of distinct texts that reach the bound, each once."""
    signed = materialise(_signed(texts))

    def check(x: str) -> DataFrame:
        return signed.select(F.col("no").alias(f"no_{x}"), F.col("check").alias(f"check_{x}"))

    pairs = materialise(_candidates(signed))
    signatures_met = spread_join(spread_join(pairs, check("a"), "no_a", "no_b", hot_keys(pairs, "no_a")), check("b"), "no_b", "no_a", hot_keys(pairs, "no_b"))
    kept = materialise(_prune(signatures_met, similarity))
    found = similar_texts(kept, texts, texts, N, similarity)
    return found.select("key_a", "key_b", (F.col("both") / F.col("either")).alias("similarity"))


def _rows(samples: DataFrame, registry: DataFrame) -> DataFrame:
    rows = with_split(spread(samples.select("id", "source", "question", "cot")), registry).where(F.col("split") == TRAIN)
    return materialise(compared_rows(rows, ["id"], ["question", "cot"], 0))


def find(samples: DataFrame, registry: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """id_a < id_b: all pairs of training rows that are near-duplicates, copies included."""
    rows = _rows(samples, registry)
    found = similar_classes(distinct_texts(rows), similarity)
    members = rows.where(F.length("text") >= N).select("key", "id").distinct()
    a, b = (members.select(F.col("key").alias(f"key_{x}"), F.col("id").alias(f"id_{x}")) for x in "ab")
    met = spread_join(b, spread_join(a, found.select("key_a", "key_b"), "key_a", "id_a"), "key_b", "id_b")
    between = met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).where("id_a <> id_b")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = pairs_within(members.join(sizes, "key"), "key", "id", "n", BLOCK).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    return between.unionAll(copies).distinct()


def groups(samples: DataFrame, registry: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per training row: id, group_id (smallest id of its group), links to other rows, copies excluded from none.

    Copies are not expanded into pairs: a row's links are its class's other members and the members
    of the classes that its class is similar to.
    """
    rows = _rows(samples, registry)
    found = materialise(similar_classes(distinct_texts(rows), similarity))
    members = rows.select("key", "id", (F.length("text") >= N).alias("long")).distinct()
    size = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("long").alias("long"))
    both = found.select(F.col("key_a").alias("key"), F.col("key_b").alias("other")).unionAll(found.select(F.col("key_b").alias("key"), F.col("key_a").alias("other")))
    linked = both.join(size.select(F.col("key").alias("other"), F.col("n").alias("m")), "other").groupBy("key").agg(F.sum("m").alias("others"))
    roots = components(found.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))).select(F.col("node").alias("key"), "root")
    # texts without any window stay alone, however often they occur
    classes = size.join(linked, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")).withColumn("others", F.coalesce("others", F.lit(0)))
    named = classes.groupBy("root").agg(F.min("first_id").alias("group_id"))
    wide = classes.join(named, "root").select("key", "group_id", "long", F.when(F.col("long"), F.col("n") - 1 + F.col("others")).otherwise(0).alias("links"))
    return members.select("id", "key").join(wide, "key").select("id", F.when(F.col("long"), F.col("group_id")).otherwise(F.col("id")).alias("group_id"), "links")
