import random

import numpy as np

from corpuloom.functions.windows import compared
from corpuloom.llm import repetition as R


def brute(text):
    t = compared(text)
    seen, again = set(), 0
    n = max(len(t) - 7, 0)
    for i in range(n):
        w = t[i : i + 8]
        again += w in seen
        seen.add(w)
    return again / n if n else 0.0


def corpus():
    random.seed(3)
    out = []
    for _ in range(400):
        piece = "".join(random.choices("甲乙丙丁abcd1，。 ", k=random.randint(1, 60)))
        text = piece * random.choice([1, 1, 2, 3, 9])
        out.append(text + "".join(random.choices("子丑寅卯辰巳午未", k=random.randint(0, 80))))
    return [*out, None, "", "  ", "啊" * 15, "啊" * 16, "ab" * 50_000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "out_id bigint, output string, share string")


def test_found(spark):
    texts = corpus()
    want = {i for i, t in enumerate(texts) if len(compared(t)) >= 16 and brute(t) >= 0.4}
    found = R.repeated(frame(spark, texts)).collect()
    assert {r["out_id"] for r in found} == want and len(want) > 50 and len(found) == len(want)
    both = frame(spark, texts).unionAll(frame(spark, texts))
    assert R.repeated(both).count() == len(want)


def test_shares(spark):
    texts = corpus()
    got = {r["out_id"]: r["share"] for r in R.shares(frame(spark, texts)).collect()}
    assert all(abs(got[i] - brute(t)) < 1e-12 for i, t in enumerate(texts))
    rows = frame(spark, ["一句重复的话。一句重复的话。另一句。", "行\n行\n别的"])
    s = {r["out_id"]: r for r in R.shares(rows).collect()}
    assert abs(s[0]["sentence_share"] - 6 / 15) < 1e-9 and abs(s[1]["line_share"] - 1 / 4) < 1e-9


def test_rules_only_reject_what_is_below():
    texts = [compared(t) for t in corpus() if t]
    need = R._needed(texts, 0.4)
    truth = np.array([brute(t) >= 0.4 and len(t) >= 16 for t in texts])
    for name, rule in R.RULES.items():
        assert not (rule(texts, need) & truth).any(), name
    for order in (list(R.RULES), list(R.RULES)[::-1], []):
        got = R._cascade(texts, ["too_short", *[o for o in order if o != "too_short"]], 0.4) >= 0.4
        assert (got == truth).all()
    assert set(R.order_rules(texts)) <= set(R.RULES) and R.order_rules([]) is not None


def test_empty_and_null_keys(spark):
    assert R.repeated(frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "重复重复" * 20)], "out_id bigint, output string")
    assert R.repeated(rows).count() == 1
