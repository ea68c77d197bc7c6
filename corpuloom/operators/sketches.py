"""Tables of fixed size that tell for a 64-bit hash how often it occurs at most.

A sketch has 2**log2 counters of one byte (saturating), addressed by a hash's upper bits. It is sized
by the number of hashes expected, but never beyond ``MOST_LOG2``; so it can be broadcast however
large the data are. It errs on one side only: a hash that occurs is never missed, and a
count is never too small (but for saturation). A full sketch lets more hashes pass, which the
joins after it sort out: the bound costs time, never rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 64 MB at most.
MOST_LOG2 = 26
SLOTS_PER_HASH = 16
_SEGMENT = 16  # log2 of the counters of a segment


class Sketch:
    """Counters by segment, compressed; put together where they are first asked."""

    def __init__(self, segments: dict[int, bytes], log2: int):
        self.segments, self.log2 = segments, log2
        self._counts: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"segments": self.segments, "log2": self.log2, "_counts": None}

    def of(self, h: np.ndarray) -> np.ndarray:
        """Upper bounds of the counts of hashes (saturating at 255)."""
        if self._counts is None:
            self._counts = np.zeros(1 << self.log2, np.uint8)
            for seg, packed in self.segments.items():
                self._counts[seg << _SEGMENT : (seg + 1) << _SEGMENT] = np.frombuffer(zlib.decompress(packed), np.uint8)
        return self._counts[(h.astype(np.uint64) >> np.uint64(64 - self.log2)).astype(np.int64)]

    def has(self, h: np.ndarray) -> np.ndarray:
        return self.of(h) > 0


#: Counters of one segment: their places in it (16 bits each) and counts (8 bits each).
SLOTS = "seg int, slot binary, c binary"


def log2_for(expected: int, most_log2: int = MOST_LOG2) -> int:
    """Size of a sketch of so many hashes."""
    return min(max(math.ceil(math.log2(max(expected, 1) * SLOTS_PER_HASH)), _SEGMENT), most_log2)


def slots(h: np.ndarray, log2: int, times: np.ndarray | None = None) -> pa.RecordBatch:
    """The counters of some hashes, one row per segment, so that no row stands for a single hash."""
    slot = (h.view(np.uint64) >> np.uint64(64 - log2)).astype(np.int64)
    if times is None:
        u, c = np.unique(slot, return_counts=True)
    else:
        u, same = np.unique(slot, return_inverse=True)
        c = np.bincount(same, weights=times, minlength=len(u))
    seg = u >> _SEGMENT
    heads = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])[: len(u)])
    edges = np.append(heads, len(u)).tolist()
    place, count = (u & ((1 << _SEGMENT) - 1)).astype(np.uint16), np.minimum(c, 255).astype(np.uint8)
    cut = list(zip(edges[:-1], edges[1:]))
    return pa.RecordBatch.from_arrays([pa.array(seg[heads].astype(np.int32)), pa.array([place[i:j].tobytes() for i, j in cut], pa.binary()), pa.array([count[i:j].tobytes() for i, j in cut], pa.binary())], ["seg", "slot", "c"])


def assembled(counted: DataFrame, log2: int) -> Broadcast:
    """Broadcast :class:`Sketch` of rows of :func:`slots`: one shuffle, segments are built on the executors.

    The driver puts a number of segments together that is fixed by the size of the sketch.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for seg, slot, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                part = own.setdefault(seg, np.zeros(1 << _SEGMENT, np.uint16))
                at = np.frombuffer(slot, np.uint16)  # each place once
                part[at] = np.minimum(part[at] + np.frombuffer(c, np.uint8), 255)
        for s, part in own.items():
            yield pa.RecordBatch.from_pydict({"seg": pa.array([s], pa.int32()), "counts": pa.array([zlib.compress(part.astype(np.uint8).tobytes(), 1)], pa.binary())})

    parts = min(16, max(1, (1 << log2 - _SEGMENT) // 16))
    made = counted.repartition(parts, "seg").mapInArrow(build, "seg int, counts binary")
    segments = {seg: bytes(counts) for seg, counts in made.collect()}  # their number is fixed by log2
    return counted.sparkSession.sparkContext.broadcast(Sketch(segments, log2))


#: Hashes that a task counts at a time.
_AT_ONCE = 2_000_000


def sketch(hashes: DataFrame, expected: int, most_log2: int = MOST_LOG2) -> Broadcast:
    """Broadcast :class:`Sketch` of the column ``h`` (times ``n`` where there is such a column); counters are summed by task before the shuffle."""
    log2 = log2_for(expected, most_log2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, size = [], [], 0
        for b in batches:
            h.append(b.column(0).to_numpy())
            n.append(b.column(1).to_numpy() if b.num_columns > 1 else np.ones(b.num_rows))
            size += b.num_rows
            if size >= _AT_ONCE:
                yield slots(np.concatenate(h), log2, np.concatenate(n))
                h, n, size = [], [], 0
        if size:
            yield slots(np.concatenate(h), log2, np.concatenate(n))

    return assembled(hashes.select("h", *(["n"] if "n" in hashes.columns else [])).mapInArrow(count, SLOTS), log2)


def frequent(rows: DataFrame, members: Broadcast, least: int) -> DataFrame:
    """The rows whose hash ``h`` has a count of at least ``least`` (255 at most) in the sketch, and some that only share its counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = members.value
        for b in batches:
            yield b.filter(pa.array(counts.of(b.column(b.schema.get_field_index("h")).to_numpy()) >= min(least, 255)))

    return rows.mapInArrow(run, rows.schema)
