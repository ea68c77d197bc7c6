"""Problem 2: repetition inside a single document.

The measure is the share of windows of 8 characters (counted by position) that already occurred
earlier in the same text, which is ``1 - distinct / windows``. Only texts that reach a threshold
are wanted, so texts are put through a cascade of rules that each *prove* a text to be below it:
a lower bound on the number of distinct windows is enough. On the first rows of its partition each
task measures every rule's cost and the share of texts that it rejects, and orders the rules by
rejections per cost; the exact count comes last, for the texts that no rule rejects. Rules are
proofs, so order and sample change the time taken and never the result.

Defined results: null counts as empty; texts with fewer than 16 characters of compared text are
never cases and have a share of 0 unless measured otherwise by :func:`shares`. Very long texts are
measured whole. Rows delivered twice (same id) count once. Rows with a null id are kept as one row.
An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuloom.functions.windows import chunks, compared, distinct_windows
from corpuloom.runtime import spread

N = 8
LEAST_CHARS = 16
SHARE = 0.4
SAMPLE = 256


def _too_short(texts: list[str], need: np.ndarray) -> np.ndarray:
    return np.fromiter((len(t) < LEAST_CHARS for t in texts), bool, len(texts))


def _many_characters(texts: list[str], need: np.ndarray) -> np.ndarray:
    """Every distinct character that starts a window starts a distinct one."""
    return np.fromiter((len(set(t)) - (N - 1) for t in texts), np.int64, len(texts)) > need


def _many_trigrams(texts: list[str], need: np.ndarray) -> np.ndarray:
    owner, _ = distinct_windows(texts, 3)
    return np.bincount(owner, minlength=len(texts)) - (N - 3) > need


def _distinct_beginning(texts: list[str], need: np.ndarray) -> np.ndarray:
    """The windows of a beginning are some of the text's windows."""
    owner, _ = distinct_windows([t[: int(k) + N + len(t) // 20] for t, k in zip(texts, need)], N)
    return np.bincount(owner, minlength=len(texts)) > need


RULES: dict[str, Callable[[list[str], np.ndarray], np.ndarray]] = {
    "too_short": _too_short, "many_characters": _many_characters, "distinct_beginning": _distinct_beginning, "many_trigrams": _many_trigrams,
}


def _needed(texts: list[str], share: float) -> np.ndarray:
    """More distinct windows than this prove the share to be below the threshold."""
    n = np.fromiter((max(len(t) - N + 1, 0) for t in texts), np.float64, len(texts))
    return n * (1 - share) + 1e-9


def order_rules(texts: list[str], share: float = SHARE) -> list[str]:
    """Rules by rejections per second on a sample, each on what the ones before leave over."""
    left, rest = [k for k in RULES], list(texts)
    ordered: list[str] = []
    while left and rest:
        found = []
        for name in left:
            began = time.perf_counter()
            out = RULES[name](rest, _needed(rest, share))
            found.append((out.sum() / max(time.perf_counter() - began, 1e-7), name, out))
        gain, name, out = max(found, key=lambda x: x[0])
        if gain == 0:
            break
        ordered.append(name)
        left.remove(name)
        rest = [t for t, o in zip(rest, out) if not o]
    return ordered + (left if not rest else [])


def window_shares(texts: list[str]) -> np.ndarray:
    """Exact share of repeated windows of each compared text."""
    n = np.fromiter((max(len(t) - N + 1, 0) for t in texts), np.int64, len(texts))
    owner, _ = distinct_windows(texts, N)
    return np.where(n > 0, 1 - np.bincount(owner, minlength=len(texts)) / np.maximum(n, 1), 0.0)


def _cascade(texts: list[str], order: list[str], share: float) -> np.ndarray:
    alive = np.arange(len(texts))
    for name in order:
        part = [texts[k] for k in alive]
        if not part:
            break
        alive = alive[~RULES[name](part, _needed(part, share))]
    out = np.full(len(texts), np.nan)
    if len(alive):
        out[alive] = window_shares([texts[k] for k in alive])
    return out


def repeated(df: DataFrame, id_col: str = "out_id", text_col: str = "output", share: float = SHARE) -> DataFrame:
    """``id_col``, ``share`` of the texts whose share of repeated windows is at least ``share``."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: list[str] | None = None
        for b in batches:
            texts = [compared(t) for t in b.column(1).to_pylist()]
            if order is None:
                order = ["too_short", *(r for r in order_rules([t for t in texts[:SAMPLE] if len(t) >= LEAST_CHARS], share) if r != "too_short")]
            for i, j in chunks(texts):
                s = _cascade(texts[i:j], order, share)
                keep = np.flatnonzero(s >= share - 1e-12)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep + i)), pa.array(s[keep])], [id_col, "share"])

    found = spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, share double")
    return found.dropDuplicates([id_col])


def shares(df: DataFrame, id_col: str = "out_id", text_col: str = "output") -> DataFrame:
    """``id_col``, share of repeated windows, sentences and lines of every text (0 to 1).

    Repeated sentences and lines are measured by their characters of compared text.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def pieces(text: str | None, cut) -> float:
        seen: set[str] = set()
        total = again = 0
        for p in cut(text or ""):
            c = compared(p)
            total += len(c)
            again += len(c) * (c in seen)
            seen.add(c)
        return again / total if total else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        sentences, lines = re.compile(r"[。！？!?；;\n]+|\.(?=\s)").split, str.splitlines
        for b in batches:
            raw = b.column(1).to_pylist()
            texts = [compared(t) for t in raw]
            for i, j in chunks(texts):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(window_shares(texts[i:j])), pa.array([pieces(t, sentences) for t in raw[i:j]], pa.float64()), pa.array([pieces(t, lines) for t in raw[i:j]], pa.float64())],
                    [id_col, "share", "sentence_share", "line_share"],
                )

    out = spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, share double, sentence_share double, line_share double")
    return out.groupBy(id_col).agg(*(F.max(c).alias(c) for c in ("share", "sentence_share", "line_share")))
