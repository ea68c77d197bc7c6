import pytest
from pyspark.sql import functions as F

from corpuloom.functions.stats import nice_max, short_count, verdict_name
from corpuloom.operators import evaluation as E
from corpuloom.operators import loadtest as L


def graded(spark, rows):
    return spark.createDataFrame(rows, "run string, set_name string, id string, correct boolean")


def test_wilson(spark):
    rows = [("a", "s", str(i), i < 5) for i in range(10)] + [("b", "s", str(i), False) for i in range(10)] + [("c", "s", str(i), True if i < 5 else None if i < 9 else False) for i in range(10)]
    t = {r["run"]: r for r in E.tally(graded(spark, rows), "run", "set_name").collect()}
    assert (t["a"]["ci_low"], t["a"]["ci_high"]) == pytest.approx((0.2366, 0.7634), abs=1e-4)
    assert (t["b"]["ci_low"], t["b"]["ci_high"]) == pytest.approx((0, 0.2775), abs=1e-4)
    assert (t["c"]["n"], t["c"]["acc"], t["c"]["abstain_rate"]) == (10, 0.5, 0.4)
    table = E.markdown_table(E.tally(graded(spark, rows), "run"), "a")
    assert "| c | 10 | 50.0 |" in table and "| b | 10 | 0.0 |" in table and "-50.0" in table


def test_baseline(spark):
    rows = [("base", "s", str(i), i < 50) for i in range(100)] + [("up", "s", str(i), i < 90) for i in range(100)] + [("flat", "s", str(i), i < 52) for i in range(100)] + [("down", "s", str(i), i < 10) for i in range(100)] + [("lone", "t", "1", True)]
    got = {r["run"]: r["delta_class"] for r in E.against_baseline(E.tally(graded(spark, rows), "run", "set_name"), "base").collect()}
    assert got == {"base": None, "up": "up", "flat": "flat", "down": "down", "lone": None}


def test_transitions(spark):
    a = spark.createDataFrame([("1", True), ("2", None), ("3", False), ("4", True)], "id string, correct boolean")
    b = spark.createDataFrame([("1", None), ("2", True), ("3", True), ("5", True)], "id string, correct boolean")
    assert tuple(E.transitions(a, b).first()) == (3, 2, 1, 1)


def test_buckets(spark):
    cases = [
        ((True, False, None, True), "regression"), ((True, None, None, None), "all_correct"), ((False, False, False, True), "dpo_fix"), ((None, None, None, None), "all_correct"), ((False, None, False, False), "all_wrong"),
        ((None, True, True, True), "dpo_fix"), ((None, False, None, True), "dpo_fix"), ((True, True, False, True), "mixed"), ((False, True, True, False), "mixed"), ((None, False, None, None), "all_wrong"), ((True, True, True, True), "all_correct"), ((False, False, False, None), "all_wrong"),
    ]
    df = spark.createDataFrame([(i, *v) for i, (v, _) in enumerate(cases)], "i int, b boolean, s boolean, r boolean, d boolean").orderBy("i")
    got = [x[0] for x in df.select(E.bucket(F.col("b"), [F.col("s"), F.col("r")], F.col("d"))).collect()]
    assert got == [w for _, w in cases]


def test_common_and_first(spark):
    rows = [("a", "s", "x-2", True), ("a", "s", "x-10", True), ("b", "s", "x-2", None), ("b", "s", "x-10", False), ("a", "s", "x-3", True), ("a", "t", "y", True)]
    wide = E.common_questions(graded(spark, rows), ["a", "b", "c"], "set_name")
    assert sorted(r["id"] for r in wide.collect()) == ["x-10", "x-2", "y"]
    assert E.common_questions(graded(spark, []), ["a"], "set_name").count() == 0
    first = E.first_of_bucket(wide.withColumn("bucket", F.lit("m")), 1, "set_name")
    assert sorted(r["id"] for r in first.collect()) == ["x-10", "y"]


def test_replay(spark):
    samples = spark.createDataFrame([("1", "s", "q", None, "g")], "id string, source string, question string, options map<string,string>, gold string")
    answers = spark.createDataFrame([("1", "a", "<think>t</think>c", True, "rule"), ("1", "b", None, None, "missing")], "id string, run string, output string, correct boolean, method string")
    r = E.replay(spark.createDataFrame([("1", "mixed")], "id string, bucket string"), samples, answers).first()
    assert r["answers"]["a"]["conclusion"] == "c" and r["answers"]["b"]["conclusion"] is None


def test_load(spark):
    rows = [(1, 100.0, 200.0, 5, True, 10.0), (1, 100.0, 200.0, 1, True, 10.0), (1, None, 300.0, 2, True, 10.0), (1, None, None, 0, False, 10.0), (2, None, None, 0, False, 5.0)]
    got = {r["c"]: r for r in L.levels(spark.createDataFrame(rows, "c int, ttft_ms double, total_ms double, out_tokens int, ok boolean, wall_s double"), ["c"]).collect()}
    assert (got[1]["requests"], got[1]["failed"], got[1]["tpot_p50"], got[1]["tpot_p95"], got[1]["output_tok_s"]) == (3, 1, 25.0, 100.0, 0.8)
    assert (got[2]["requests"], got[2]["failed"], got[2]["ttft_p50"], got[2]["output_tok_s"]) == (0, 1, None, None)
    four = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "c int, v double")
    assert tuple(L.percentiles(four, "v", {"p": 0.5, "q": 1.0}, ["c"]).first()) == (1, 3.0, 4.0)
    summary = spark.createDataFrame([("x", 100.0), ("x", None), ("y", 120.0)], "label string, output_tok_s double")
    assert L.gain(summary, "x", "y").first()["gain"] == pytest.approx(20)


def test_shown_numbers(spark):
    df = spark.createDataFrame([(999, 0.034, True), (1500, 45.0, None), (12345, 0.0, False)], "n int, v double, c boolean")
    got = [tuple(r) for r in df.select(short_count(F.col("n")), nice_max(F.col("v")), verdict_name(F.col("c"))).collect()]
    assert [g[0] for g in got] == ["999", "1.5k", "12.3k"] and [g[2] for g in got] == ["correct", "abstain", "wrong"]
    assert [g[1] for g in got] == pytest.approx([0.04, 50, 0])
