import pytest
from pyspark.sql import functions as F

from corpuloom.functions.extract import extract_choice, extract_text, judge_reply, keep_ends, split_thinking

CHOICE = [
    ("\\boxed{C}", "C"), ("所以 \\boxed{A、C}", "AC"), ("\\boxed{\\text{B}}", "B"), ("\\boxed{ABD}", "ABD"), ("最终答案:B", "B"), ("答案是 D", "D"), ("答案为【A】", "A"), ("故选E。", "E"), ("不应选B", None), ("勿故选A", None),
    ("The answer is (d).", "D"), ("answer: c", "C"), ("答案:A,B", "AB"), ("答案:A，C", "A"), ("答案：C", None), ("答案:ABD", None), ("答案:B 后来更正 答案:C", "C"), ("\\boxed{A} 但最终答案:B", "B"), ("选项里的A", None),
    ("答案:A型血", None), ("", None), ("答案:CT", None), ("x" * 3000 + "答案:A", "A"), ("答案:A" + "x" * 3000, None), ("\\boxed{}", None), ("\\boxed{42}", None),
]
TEXT = [("\\boxed{肺炎}", "肺炎"), ("\\boxed{ 肺 炎。}", "肺 炎"), ("最终答案: 肺炎。", "肺炎"), ("答案为胃炎」。", "胃炎"), ("\\boxed{a}\n答案:b", "a"), ("答案:x\n后来答案:y", "y"), ("结论是肺炎", None), ("答案:。", None), ("", None), ("\\boxed{a} \\boxed{b}", "b")]


@pytest.mark.parametrize("cases,read", [(CHOICE, extract_choice), (TEXT, extract_text)])
def test_declarations(spark, cases, read):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["a"] for r in rows.select("i", read(F.col("t")).alias("a")).collect()}
    assert {cases[i][0][-40:]: v for i, v in got.items()} == {t[-40:]: v for t, v in cases}


def test_wide_reading(spark):
    cases = {"答案：C": ("C", None), "答案:ABD": ("ABD", None), "答案:A，C。": ("AC", "A"), "故选（B）": ("B", None), "答案：ABC综合征": (None, None), "\\boxed{CA}": ("AC", "AC"), "不故选A": (None, None), "the answer is (b)": ("B", "B")}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: (r[1], r[2]) for r in rows.select("t", extract_choice(F.col("t"), wide=True), extract_choice(F.col("t"))).collect()} == cases


def test_wrapped_text(spark):
    cases = {r"\boxed{\text{肺栓塞}}": "肺栓塞", r"so \boxed{\mathrm{ATP}}。": "ATP", "答案: \\mathbf{胃}。": "胃"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in rows.select("t", extract_text(F.col("t"))).collect()} == cases


def test_null_output(spark):
    row = spark.createDataFrame([(None,)], "t string").select(extract_choice(F.col("t")), extract_text(F.col("t"))).first()
    assert tuple(row) == (None, None)


def test_thinking(spark):
    cases = [("<think> a </think> b ", ("a", "b")), ("a</think>b</think>c", ("a</think>b", "c")), (" plain ", ("", "plain")), ("<think>open", ("", "<think>open")), ("</think>", ("", "")), (None, (None, None))]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").orderBy("i")
    assert [tuple(r) for r in rows.select(*split_thinking(F.col("t"))).collect()] == [w for _, w in cases]


def test_keep_ends(spark):
    row = spark.createDataFrame([("abcdefgh", "abcd")], "a string, b string").select(keep_ends(F.col("a"), 4), keep_ends(F.col("b"), 4)).first()
    assert row[0].startswith("ab\n\n……") and row[0].endswith("……\n\ngh") and row[1] == "abcd"


def test_judge_reply(spark):
    cases = {'ok {"correct": true, "reason": "x"}': True, '{"correct": false}': False, '{"correct": "true"}': None, '{"correct": 1}': None, "no json": None, "{}": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in rows.select("t", judge_reply(F.col("t"))).collect()} == cases
