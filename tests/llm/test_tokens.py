import base64
import random

import pytest
from pyspark.sql import functions as F

from corpuloom.llm import mixing, tokens


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(tokens.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("reference", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(seed=1, n=800):
    random.seed(seed)
    letters = "ab Zé1²½ \n\t'srtlm。，　中文字\x1c\x85​́😀\x00_<|>"
    return ["".join(random.choices(letters, k=random.randint(0, 60))) for _ in range(n)] + ["", " ", "\n\n", "don't we'll I've 'S", "<|endoftext|>", "a" * 5000, "中" * 3000, "it's  1234  x\n \n y", "\x00\x00"]


def test_same_ids(reference):
    rows = texts()
    values, ends = tokens.Encoder().encode_flat([*rows, None])
    got = [values[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
    assert got == [reference.encode_ordinary(t) for t in rows] + [[]]
    assert tokens.encoder().count([*rows, None]).tolist() == [len(g) for g in got]


def test_round_trip():
    rows = texts(2, 200)
    e = tokens.encoder()
    for t in rows:
        assert e.decode(e.encode_flat([t])[0].tolist()) == t


def test_frame(spark, reference):
    data = [(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (1, "a b", "x"), (None, "中文", "x"), (4, "字" * 300_000, "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string")
    out = tokens.encode(df)
    assert [f.simpleString() for f in out.schema] == ["doc_id:bigint", "ids:array<int>"]
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in out.collect()), key=str)
    assert got == sorted(((i or 0, reference.encode_ordinary(t or "")) for i, t, _ in data), key=str)
    assert tokens.encode(df.limit(0)).count() == 0


DOCS = "doc_id bigint, text string, source string, n_tokens string, copies string"


def mix(spark, docs, targets, **k):
    d = spark.createDataFrame([(i, t, s, "clash", "clash") for i, t, s in docs], DOCS)
    g = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mix(d, g, **k)
    return {r["doc_id"]: r["copies"] for r in mixed.collect()}, {r["source"]: r for r in shares.collect()}


def corpus():
    random.seed(4)
    docs = [(i, "word " * random.randint(1, 30), "big") for i in range(900)] + [(2000 + i, "some words here " * random.randint(1, 9), "small") for i in range(60)]
    return docs + [(5000, None, "big"), (5001, "no source", None), (5002, "other", "untargeted"), (5003, "", "small")]


def test_shares_are_met(spark):
    mixed, shares = mix(spark, corpus(), [("big", 0.7, 2), ("small", 0.3, 3), ("absent", 0.0, 2)])
    assert shares["big"]["actual_share"] == pytest.approx(0.7, abs=0.01) and shares["small"]["actual_share"] == pytest.approx(0.3, abs=0.01)
    assert shares["absent"]["actual_share"] == 0 and shares["absent"]["docs"] == 0
    assert not {5000, 5001, 5002} & mixed.keys()
    assert max(mixed.values()) <= 3 and all(c <= 2 for i, c in mixed.items() if i < 2000)
    assert shares["small"]["copies"] == sum(c for i, c in mixed.items() if i >= 2000)
    again, _ = mix(spark, corpus()[::-1], [("big", 0.7, 2), ("small", 0.3, 3), ("absent", 0.0, 2)])
    assert again == mixed


def test_given_size_is_capped(spark):
    total = 60_000
    mixed, shares = mix(spark, corpus(), [("big", 0.5, 1), ("small", 0.5, 4)], total_tokens=total)
    assert shares["big"]["tokens"] < total / 2 and shares["big"]["docs"] == 900  # all of it, once
    assert shares["small"]["copies"] == 61 * 4 or abs(shares["small"]["tokens"] - total / 2) < 100


def test_ranges_do_not_matter(spark, monkeypatch):
    one, _ = mix(spark, corpus(), [("big", 0.6, 1), ("small", 0.4, 2)])
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 17)
    many, _ = mix(spark, corpus(), [("big", 0.6, 1), ("small", 0.4, 2)])
    assert one == many


def test_empty_mix(spark):
    mixed, shares = mix(spark, [], [("big", 1.0, 1)])
    assert mixed == {} and shares["big"]["actual_share"] == 0
    assert mix(spark, corpus(), []) == ({}, {})
    assert mix(spark, corpus(), [(None, 0.5, 1), ("big", None, 1), ("small", 0.5, None)])[0] == {}


def test_no_document_twice(spark):
    d = spark.createDataFrame([(i, "x", "s") for i in range(50)], "doc_id bigint, text string, source string")
    g = spark.createDataFrame([("s", 1.0, 2), ("s", 1.0, 2)], "source string, target_share double, max_repeats int")
    mixed, _ = mixing.mix(d, g)
    assert mixed.agg(F.count("doc_id"), F.count_distinct("doc_id"), F.sum("copies")).first() == (50, 50, 100)
