"""The vocabulary of a corpus as a trie, asked for the last words of texts.

A *word* is a run of letters, lower-cased in compatibility form. In Han, where nothing stands between words, it is two
characters that follow one another (one where a run has no more). A word is *known* if somewhere in the
corpus it stands whole: before anything but a letter, in Han before a mark. It *ends* something if a mark or line end
follows. It is a *node* if it goes on somewhere: the nodes of the trie are the proper prefixes of its
words. The last word of a text that ends without any mark behind it says nothing about words, as it may
be cut itself.

The trie of a large corpus has more nodes than fit one place. Only the nodes that are asked for are looked up: the
last words form a sketch of bounded size, the corpus is scanned against it with rolling hashes of all
prefixes, and what may be asked for is joined by hash. All of the corpus counts, however rare a word is.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuloom.functions.windows import chunks, codepoints, mix64
from corpuloom.operators.sketches import sketch

_BASE = np.uint64(0x9E3779B97F4A7C15)
HAN, LETTER, MARK = 1, 2, 4
INVISIBLE = "​‌‍⁠﻿­ \t\r\n\v\f\x00 　"


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Folded code points; kind of each: Han, other letter (with accents of their own), mark or line end, or none of these."""
    fold = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(0x20000):
        if 0xAC00 <= c < 0xD7A4 or 0x3400 <= c < 0xA000 or 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        f = unicodedata.normalize("NFKC", x).lower()
        if len(f) == 1:
            fold[c] = ord(f)
        category = unicodedata.category(x)[0]
        kind[c] = LETTER if category in "LM" else MARK if category in "PS" or x == "\n" else 0
    kind[0xAC00:0xD7A4] = LETTER
    for a, b in ((0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)):
        kind[a:b] = HAN
    return fold, kind


def last_word(text: str) -> str:
    """The word that a text ends with; empty where it ends otherwise."""
    kind = tables()[1]
    end = len(text)
    if not end or (k := kind[ord(text[-1])]) not in (HAN, LETTER):
        return ""
    i = end - 1
    while i and kind[ord(text[i - 1])] == k and (k == LETTER or end - i < 2):
        i -= 1
    return text[i:]


WHOLE, ENDS, NODE = 1, 2, 4


def word_nodes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, role) of all words and prefixes of words of the texts; the role has the bits WHOLE, ENDS, NODE."""
    fold, kinds = tables()
    cps = codepoints(t + "\n" for t in texts)
    kind = kinds[cps]
    at = np.flatnonzero((kind == HAN) | (kind == LETTER))
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    own, behind = kind[at], kind[at + 1]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    place = np.arange(len(at)) - first[run]
    c = fold[cps[at]].astype(np.uint64) + np.uint64(1)
    han = own == HAN
    with np.errstate(over="ignore"):
        power = np.cumprod(np.append(np.uint64(1), np.full(int(place.max()), _BASE)))
        total = np.cumsum(c * power[place])
        h = total - np.append(np.uint64(0), total)[first][run]
        h += place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        pair = np.append(np.uint64(0), c[:-1]) * _BASE + c + np.uint64(0xA24BAED4963EE407)
        h = mix64(np.where(han & (place > 0), pair, h))
    last = behind != own
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1  # the line ends put between texts
    open_ = np.zeros(len(cps) + 1, bool)
    open_[ends] = True
    open_ = open_[at + 1]
    mark = last & (behind == MARK)
    role = (last & (~han | mark)) * WHOLE + mark * ENDS + ~last * NODE
    # the first character of a run in Han is a word of its own only where the run has no more
    ok = ~open_ & (role > 0) & ~(han & (place == 0) & ~last)
    return h[ok], role[ok].astype(np.uint8)


def word_hashes(words: list[str]) -> list[int | None]:
    """Hashes of words as :func:`word_nodes` gives them; null for empty ones."""
    h, role = word_nodes([w + "." for w in words])
    found = iter(h[role & WHOLE > 0].view(np.int64).tolist())
    return [next(found) if w else None for w in words]


def looked_up(asked: DataFrame, corpus: DataFrame) -> DataFrame:
    """word, known, ends, node of the hashes ``word`` of ``asked`` that the words or prefixes of ``corpus`` (text) have."""
    asked = asked.where("word is not null").select(F.col("word").alias("h")).distinct()
    members = sketch(asked, asked.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = members.value
        for b in batches:
            texts = [(t or "").rstrip(INVISIBLE) for t in b.column(0).to_pylist()]
            for i, j in chunks(texts):
                h, role = word_nodes(texts[i:j])
                ok = wanted.has(h)
                u, same = np.unique(h[ok], return_inverse=True)
                roles = np.zeros(len(u), np.uint8)
                np.bitwise_or.at(roles, same, role[ok])
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(roles.astype(np.int32))], ["word", "role"])

    found = corpus.select("text").mapInArrow(run, "word bigint, role int").groupBy("word").agg(F.bit_or("role").alias("role"))
    return found.select("word", *((F.col("role").bitwiseAND(bit) > 0).alias(name) for name, bit in (("known", WHOLE), ("ends", ENDS), ("node", NODE))))
