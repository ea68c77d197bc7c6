"""Batch kernels on compared text: normalising, window hashes, distinct counts.

*Compared text* is NFKC-normalised, lower-cased text from which everything but letters and digits
of any script is dropped. A *window of n* is a stretch of n consecutive characters of it. All
kernels work on chunks of bounded size, so very long texts only make a chunk of their own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np

_DROP = re.compile(r"[\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def compared(text: str | None) -> str:
    """Compared text; null counts as empty."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _DROP.sub("", text.lower())


def chunks(texts: Sequence[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``chars`` characters each (one row at least)."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def codepoints(texts: Iterable[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (all bits depend on all bits)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(texts: Sequence[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of all windows of ``n``, in order of row and position."""
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    total = int(lens.sum())
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    cps = codepoints(texts).astype(np.uint64)
    m = total - n + 1
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h *= _BASE
            h += cps[k : k + m] + np.uint64(1)
        owner = np.repeat(np.arange(len(texts)), lens)
        keep = owner[:m] == owner[n - 1 :]
        return owner[:m][keep], mix64(h[keep])


def distinct_windows(texts: Sequence[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`window_hashes`, each hash once per row, in order of row."""
    owner, h = window_hashes(texts, n)
    if not len(h):
        return owner, h
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]
