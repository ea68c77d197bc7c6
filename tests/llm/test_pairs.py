"""Leakage, overlap and near-duplicates against brute force."""

import random

import pytest
from util import corpus, of_split, registry, samples, windows

from corpuloom.functions.windows import compared
from corpuloom.llm import components, leakage, neardup, overlap


@pytest.fixture(scope="module")
def rows():
    return corpus()


def pairs(df):
    got = [tuple(r) for r in df.select("id_a", "id_b").collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    return set(got)


def test_leakage(spark, rows):
    got = pairs(leakage.find(samples(spark, rows), registry(spark)))
    want = set()
    for t in of_split(rows, True).values():
        full = compared(f"{t[2] or ''}\n{t[3] or ''}")
        for e in of_split(rows, False).values():
            w = windows(e[2], 10)
            if w and sum(x in full for x in w) >= 0.5 * len(w):
                want.add(tuple(sorted((t[0], e[0]))))
    assert got == want and len(want) > 20


def test_leakage_reports(spark, rows):
    s, r = samples(spark, rows), registry(spark)
    found = pairs(leakage.find(s, r))
    items = {x["eval_id"]: x for x in leakage.items(s, r).collect()}
    held = of_split(rows, False)
    per = {}
    for a, b in found:
        per.setdefault(a if a in held else b, []).append(b if a in held else a)
    assert {k: v["train_rows"] for k, v in items.items()} == {k: len(v) for k, v in per.items()}
    clean = {x["id"] for x in leakage.clean(s, r).collect()}
    assert clean == set(of_split(rows, True)) - {t for v in per.values() for t in v}


def test_redaction(spark, rows):
    s, r = samples(spark, rows), registry(spark)
    train, held = of_split(rows, True), of_split(rows, False)
    got = {x["id"]: x for x in leakage.redact(s, r).collect()}
    assert set(got) == set(train)
    leaked = {}
    for a, b in pairs(leakage.find(s, r)):
        leaked.setdefault(a if a in train else b, []).append(b if a in train else a)
    for k, row in train.items():
        x = got[k]
        if k not in leaked:
            assert (x["question"], x["cot"], x["removed"]) == (row[2], row[3], 0)
            continue
        full, quoted = compared(f"{row[2] or ''}\n{row[3] or ''}"), set()
        for e in leaked[k]:
            w = windows(held[e][2], 10)
            quoted |= {j for i in range(len(full) - 9) if full[i : i + 10] in w for j in range(i, i + 10)}
        left = "".join(c for i, c in enumerate(full) if i not in quoted)
        assert compared(f"{x['question'] or ''}\n{x['cot'] or ''}") == left and x["removed"] == len(quoted)


def test_removed_stretches():
    assert leakage.without("Ａb，c-d e", [(1, 3)]) == "Ａ-d e" and leakage.without("abc", []) == "abc" and leakage.without("", []) == ""
    assert leakage.without("e\u0301x y", [(0, 1)]) == "x y" and leakage.without("ab, cd", [(0, 2)]) == ", cd"


def test_overlap(spark, rows):
    want = set()
    for t in of_split(rows, True).values():
        a = windows(t[2], 5)
        for e in of_split(rows, False).values():
            b = windows(e[2], 5)
            if len(compared(e[2])) >= 10 and a and len(a & b) >= 0.6 * len(a | b):
                want.add(tuple(sorted((t[0], e[0]))))
    assert pairs(overlap.find(samples(spark, rows), registry(spark))) == want and len(want) > 15
    report = overlap.report(samples(spark, rows), registry(spark)).collect()
    assert sum(r["pairs"] for r in report) == len(want)


def test_overlap_in_many_shards(spark, rows, monkeypatch):
    whole = pairs(overlap.find(samples(spark, rows), registry(spark)))
    monkeypatch.setattr(overlap, "SHARD_CHARS", 400)
    monkeypatch.setattr(overlap, "GROUP_CHARS", 3000)
    assert pairs(overlap.find(samples(spark, rows), registry(spark))) == whole


def test_overlap_shuffles_no_index(spark, rows, monkeypatch):
    """However many meetings there are of shards and groups, tasks read both from the written tables."""
    plans, real = [], overlap.materialise

    def spied(df):
        if df.columns == ["no_a", "no_b"]:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(overlap, "materialise", spied)
    monkeypatch.setattr(overlap, "SHARD_CHARS", 400)
    monkeypatch.setattr(overlap, "GROUP_CHARS", 3000)
    assert pairs(overlap.find(samples(spark, rows), registry(spark)))
    assert len(plans) == 1 and "hashpartitioning" not in plans[0] and "CoGroup" not in plans[0]


def test_shards_held_one_at_a_time():
    import pyarrow as pa

    read = []

    def batches():
        for part, texts in ((0, ["a", "b"]), (0, ["c"]), (1, ["d"]), (2, ["e", "f"])):
            read.append(part)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(texts), pa.int32()), "no": pa.array([ord(t) for t in texts]), "text": pa.array(texts)})

    got = [(numbers.tolist(), texts, list(read)) for numbers, texts in overlap.parts(batches())]
    assert [g[1] for g in got] == [["a", "b", "c"], ["d"], ["e", "f"]] and [g[0] for g in got] == [[97, 98, 99], [100], [101, 102]]
    assert got[0][2] == [0, 0, 1] and got[1][2] == [0, 0, 1, 2]


def test_index_counts():
    import numpy as np

    random.seed(2)
    texts = ["".join(random.choices("abc甲", k=random.randint(1, 40))) for _ in range(60)] + ["aaaaaaaaaaaaaaaaaaaa"]
    ix = overlap.FullTextIndex(texts)
    for p in ["".join(random.choices("abc甲z", k=random.randint(1, 6))) for _ in range(200)] + ["aaaaaa"]:
        s = ix.symbols(np.array([ord(c) for c in p]))
        lo, hi = np.array([0]), np.array([ix.n])
        for c in s[::-1]:
            if c < 0 or lo[0] >= hi[0]:
                lo = hi = np.array([0])
                break
            lo, hi = ix.step(np.array([c]), lo, hi)
        where = [(k, i) for k, t in enumerate(texts) for i in range(len(t)) if t.startswith(p, i)]
        assert max(hi[0] - lo[0], 0) == len(where)
        assert sorted(ix.text_of[lo[0] : hi[0]].tolist()) == [k for k, _ in where]
        a, b = ix.intervals(s, np.array([0]), len(p))
        assert b[0] - a[0] == len(where)


def near(rows):
    train = of_split(rows, True)
    w = {k: windows(f"{r[2] or ''}\n{r[3] or ''}", 5) for k, r in train.items()}
    ids = sorted(w)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if w[a] and len(w[a] & w[b]) >= 0.6 * len(w[a] | w[b])}


def test_near_duplicates(spark, rows):
    want = near(rows)
    got = pairs(neardup.find(samples(spark, rows), registry(spark)))
    assert got == want and len(want) > 10
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in want:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    groups = {r["id"]: (r["group_id"], r["links"]) for r in neardup.groups(samples(spark, rows), registry(spark)).collect()}
    assert groups == {k: (root(k), sum(k in p for p in want)) for k in of_split(rows, True)}


def test_hot_group(spark, monkeypatch):
    """A third of all rows is one group of near copies; buckets are split into blocks."""
    random.seed(1)
    base = "".join(random.choices("甲乙丙丁戊己庚辛壬癸", k=120))
    rows = [(f"tr-{i:03d}", "tr", base[:i] + "变" + base[i:], None) for i in range(40)]
    rows += [(f"tr-x{i}", "tr", "".join(random.choices("子丑寅卯辰巳午未申酉戌亥", k=90)), None) for i in range(80)]
    monkeypatch.setattr(neardup, "BLOCK", 7)
    assert pairs(neardup.find(samples(spark, rows), registry(spark))) == near(rows) and len(near(rows)) == 780


def test_hot_copies(spark, monkeypatch):
    """A third of all rows are copies of one text, and as many share a stock phrase with many items; keys are divided into blocks."""
    from corpuloom.operators import skew

    random.seed(4)
    monkeypatch.setattr(skew, "BLOCK", 5)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    stock, han = "请在下列备选答案中选出与题干关系最密切的一项", "甲乙丙丁戊己庚辛壬癸子丑寅卯"
    copied = "".join(random.choices(han, k=40))
    rows = [(f"tr-c{i:02d}", "tr", copied, None) for i in range(20)]
    rows += [(f"tr-s{i:02d}", "tr", stock + "".join(random.choices(han, k=30)), None) for i in range(20)]
    rows += [(f"va-s{i:02d}", "va", stock + "".join(random.choices(han, k=i)), None) for i in range(12)] + [("te-c", "te", copied + "题", None)]
    s, r = samples(spark, rows), registry(spark)
    want = set()
    for t in of_split(rows, True).values():
        for e in of_split(rows, False).values():
            w = windows(e[2], 10)
            if len(w & windows(t[2], 10)) >= 0.5 * len(w):
                want.add(tuple(sorted((t[0], e[0]))))
    assert pairs(leakage.find(s, r)) == want and len(want) > 100
    assert {p for p in pairs(overlap.find(s, r)) if "te-c" in p} == {("te-c", f"tr-c{i:02d}") for i in range(20)}
    assert pairs(neardup.find(s, r)) == near(rows) and len(near(rows)) >= 190
    assert {(x["group_id"], x["links"]) for x in neardup.groups(s, r).collect() if x["id"].startswith("tr-c")} == {("tr-c00", 19)}


def test_posterior_bounds():
    least = neardup.least_matches(0.6)
    assert list(least) == sorted(least) and all(m < 0.6 * n for m, n in zip(least, (32, 64, 96, 128)))
    assert neardup._at_least(0.5, 32, 32) > 0.999 and neardup._at_least(0.9, 0, 32) < 1e-20


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (5, 4), (6, 6), (1, 2)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4, 5), 1), 10: 10, 11: 10, **dict.fromkeys(range(100, 131), 100)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("f", [leakage.find, leakage.items, leakage.clean, leakage.redact, overlap.find, overlap.report, neardup.find, neardup.groups])
def test_empty(spark, f):
    none = samples(spark, [])
    assert f(none, registry(spark)).count() == 0
    only = samples(spark, [("va-1", "va", "一个足够长的评测问题文本内容", None)])
    assert f(only, registry(spark)).count() == 0
