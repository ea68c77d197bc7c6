import random
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from corpuloom.functions.text import first_clause, norm_text, py_strip, shingles, sorted_letters
from corpuloom.functions.windows import compared, distinct_windows, window_hashes


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_norm_text(spark):
    assert column(spark, ["患者，AB é_1！", "", None, "…"], norm_text) == ["患者abé1", "", None, ""]


def test_strip_is_pythons(spark):
    texts = ["\u3000a b\u00a0", "\x1c\x1fx\x85\n", "\n", "x", "", "\u200bx\u200b", "a\n\nb\n"]
    assert column(spark, texts, py_strip) == [t.strip() for t in texts]


def test_shingles(spark):
    assert column(spark, ["abcabc", "ab", "", None], lambda c: shingles(c, 3)) == [["abc", "bca", "cab"], ["ab"], [], []]


def test_letters_and_clause(spark):
    assert column(spark, ["CAB", "", "AAB"], sorted_letters) == ["ABC", "", "AB"]
    assert column(spark, ["a,b", "a。b;c", "abc"], first_clause) == ["a", "a", "abc"]


def test_compared_text():
    assert compared("Ａｂ－１ ﬁx_①") == "ab1fix1"
    assert compared(None) == compared(" \n") == ""


def test_windows_against_slices():
    random.seed(1)
    texts = ["".join(random.choices("ab甲𠀀", k=random.randint(0, 30))) for _ in range(200)]
    for n in (1, 3, 8):
        owner, h = window_hashes(texts, n)
        want = [(k, t[i : i + n]) for k, t in enumerate(texts) for i in range(len(t) - n + 1)]
        assert owner.tolist() == [k for k, _ in want]
        assert len(set(zip([w for _, w in want], h.tolist()))) == len({w for _, w in want}) == len(set(h.tolist()))
        owner, _ = distinct_windows(texts, n)
        assert np.bincount(owner, minlength=200).tolist() == [len({t[i : i + n] for i in range(len(t) - n + 1)}) for t in texts]


def test_normal_forms_are_stable():
    for t in ("ﬀ", "½", "Å", "ｶﾞ"):
        assert compared(t) == compared(unicodedata.normalize("NFKC", t))
