"""Problem 8: encode a corpus with a public byte-level BPE vocabulary.

The rank file is re-expressed as a sentencepiece BPE model: the model's protocol buffer is
serialised here directly from the vocabulary. Every byte string becomes a piece of the
one-character-per-byte alphabet of byte-level vocabularies, scored by its negative rank, with
identity normalisation. Sentencepiece merges the best-scored adjacent pair first, leftmost on
ties, which is the merge order of the ranks. Texts are cut into pre-tokens by the vocabulary's
pattern, pre-tokens are encoded, and piece ids equal ranks, so no id mapping is left to do.

Defined results: empty and null texts both give an empty list. Very long texts are encoded whole.
Repeated rows give repeated rows. An empty table gives an empty table with the same schema. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuloom.functions.windows import mix64
from corpuloom.runtime import spread

#: Pre-token pattern of the public byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    """Path of byte_bpe_50k's rank file: $CORPULOOM_TOKENIZERS, else the installed files."""
    base = os.environ.get("CORPULOOM_TOKENIZERS")
    if not base:
        spec = importlib.util.find_spec("public_tokenizers")
        base = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(base, "byte_bpe_50k.tiktoken")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones stand for themselves."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def build_model(vocabulary: str) -> bytes:
    """The serialised sentencepiece model of a rank file (lines: base64 bytes, rank)."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    alphabet = byte_alphabet()
    pieces = sorted((rank, "".join(alphabet[x] for x in token)) for token, rank in ranks.items())
    if [rank for rank, _ in pieces] != list(range(len(pieces))):
        raise ValueError("ranks must be contiguous from 0")
    out = bytearray()
    for rank, piece in pieces:
        out += _field(1, _field(1, piece.encode()) + b"\x15" + struct.pack("<f", -float(rank)))
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _flag(3, 2))
    # trainer: BPE, the unknown piece after the vocabulary, no other control pieces
    minus_one = (1 << 64) - 1
    trainer = _flag(3, 2) + _flag(4, len(pieces) + 1) + _flag(40, len(pieces)) + b"".join(_flag(k, minus_one) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


class Encoder:
    """Encodes and decodes texts; remembers the ids of recent pre-tokens.

    Texts of a batch are cut into pre-tokens together, on an array of character classes. Only a
    text with an apostrophe, where the pattern's contractions may apply, goes through the pattern
    itself. Every distinct pre-token of a batch is encoded once.
    """

    #: Pre-tokens remembered; beyond it the memory starts anew (speed only).
    MEMORY = 300_000

    def __init__(self, vocabulary: str | None = None):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=build_model(vocabulary or default_vocabulary()))
        self.alphabet = byte_alphabet()
        self.letters = np.array([ord(c) for c in self.alphabet], dtype="<u2")
        self.inverse = {ord(c): b for b, c in enumerate(self.alphabet)}
        self.split = regex.compile(PATTERN).findall
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.kind = np.zeros(0x110000, np.uint8)  # 0 other, 1 letter, 2 number, 3 white space
        for k, cls in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
            self.kind[np.frombuffer("".join(regex.findall(cls + "+", every)).encode("utf-32-le"), np.uint32)] = k
        self.known: dict[str, np.ndarray] = {}

    def _ids(self, pre: list[str]) -> list[np.ndarray]:
        if len(self.known) + len(pre) > self.MEMORY:
            self.known = {}
        new = [p for p in pre if p not in self.known]
        if new:
            raw = np.frombuffer("\0".join(new).encode(), np.uint8)
            mapped = self.letters[raw].tobytes().decode("utf-16-le").split(self.alphabet[0])
            if len(mapped) != len(new):  # a text has the separator itself
                mapped = [self.letters[np.frombuffer(p.encode(), np.uint8)].tobytes().decode("utf-16-le") for p in new]
            self.known.update(zip(new, (np.array(x, np.int32) for x in self.model.encode(mapped, num_threads=1))))
        return [self.known[p] for p in pre]

    def _starts(self, text: str, cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin in the joined texts, were there no apostrophes."""
        kind = self.kind[cps]
        n = len(cps)
        space = kind == 3
        first = np.zeros(n, bool)
        first[0] = True
        first[ends[ends < n]] = True
        before_space = np.zeros(n, bool)
        before_space[1:] = space[:-1]
        before_blank = np.zeros(n, bool)
        before_blank[1:] = cps[:-1] == 32
        before_kind = np.zeros(n, np.uint8)
        before_kind[1:] = kind[:-1]
        word = ~space & np.where(before_space, ~before_blank, kind != before_kind)
        last_of_run = np.zeros(n, bool)
        last_of_run[:-1] = space[:-1] & ~space[1:] & ~first[1:]
        return first | word | space & (~before_space | last_of_run)

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pre-tokens, which of them follow one another, and how many each text has."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        text = "".join(texts)
        if not text:
            return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lens)
        start = self._starts(text, cps, ends)
        for k in np.flatnonzero(np.fromiter(("'" in t for t in texts), bool, len(texts))):
            at = int(ends[k] - lens[k])
            sizes = np.fromiter(map(len, self.split(texts[k])), np.int64)
            start[at : int(ends[k])] = False
            start[at + np.cumsum(sizes) - sizes] = True
        at = np.flatnonzero(start)
        stop = np.append(at[1:], len(cps))
        place = np.arange(len(cps)) - np.repeat(at, stop - at)
        with np.errstate(over="ignore"):
            code = mix64(cps.astype(np.uint64) * np.uint64(0x100000001B3) + place.astype(np.uint64))
            h = mix64(np.add.reduceat(code, at) + (stop - at).astype(np.uint64))
        _, pick, inverse = np.unique(h, return_index=True, return_inverse=True)
        pre = [text[i:j] for i, j in zip(at[pick].tolist(), stop[pick].tolist())]
        per_text = np.searchsorted(at, ends) - np.searchsorted(at, ends - lens)
        return pre, inverse, per_text

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the place where each text's ids end, from 0 on."""
        pre, which, per_text = self.cut([t or "" for t in texts])
        offsets = np.zeros(len(texts) + 1, np.int64)
        if not pre:
            return np.zeros(0, np.int32), offsets
        ids = self._ids(pre)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, begin = np.concatenate(ids), np.cumsum(size) - size
        n = size[which]
        done = np.cumsum(n)
        values = flat[np.repeat(begin[which] - (done - n), n) + np.arange(int(done[-1]))]
        offsets[1:] = np.concatenate(([0], done))[np.cumsum(per_text)]
        return values, offsets

    def count(self, texts: list[str | None]) -> np.ndarray:
        pre, which, per_text = self.cut([t or "" for t in texts])
        if not pre:
            return np.zeros(len(texts), np.int64)
        done = np.concatenate(([0], np.cumsum(np.fromiter(map(len, self._ids(pre)), np.int64, len(pre))[which])))
        return np.diff(done[np.concatenate(([0], np.cumsum(per_text)))])

    def decode(self, ids: list[int]) -> str:
        return bytes(self.inverse[ord(c)] for i in ids for c in self.model.id_to_piece(int(i))).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def encoder(vocabulary: str | None = None) -> Encoder:
    """The encoder of this worker process; tasks that it runs later find it ready."""
    return Encoder(vocabulary)


def _parts(texts: list[str | None], chars: int = 500_000) -> Iterator[list[str | None]]:
    part: list[str | None] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id_col``, ``ids``: the token ids of every text, in order, without special tokens."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            texts, at = b.column(1).to_pylist(), 0
            for part in _parts(texts):
                values, offsets = enc.encode_flat(part)
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), ids], [id_col, "ids"])
                at += len(part)

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text_col: str = "text", out: str = "n_tokens", vocabulary: str | None = None) -> DataFrame:
    """``df`` with ``text_col`` replaced by its number of tokens (0 for empty and null texts)."""
    keep = [c for c in df.columns if c != text_col]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", `{out}` bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            counts = [np.zeros(0, np.int64)]
            for part in _parts(b.column(len(keep)).to_pylist()):
                counts.append(enc.count(part))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(np.concatenate(counts))], [*keep, out])

    return spread(df.select(*keep, text_col)).mapInArrow(run, schema)
