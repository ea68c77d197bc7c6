import json

import pytest

from corpuloom.plans import pipelines as P
from corpuloom.sources import chat

SAMPLE = "id string, source string, question string, gold string, options map<string,string>, cot string"
Q = "患者男性五十二岁突发胸骨后压榨样疼痛两小时伴大汗最可能的诊断是什么"


def test_pool_and_finetuning(spark):
    train = spark.createDataFrame([("t-1", "t", Q, "g", None, "c"), ("t-2", "t", "完全无关的一道题目，内容不同，没有任何重合之处", "g", None, "c")], SAMPLE)
    held = spark.createDataFrame([("e-1", "e", Q, "A", {"A": "x"}, None)], SAMPLE)
    bad = spark.createDataFrame([(0, "e", "r", "d")], "ord bigint, source string, reason string, detail string")
    pool = P.build_pool(train, held, bad)
    assert [r["id"] for r in pool.clean.collect()] == ["t-2"]
    assert "2 training rows, 1 removed, 1 kept" in pool.report and "| e | 1 | 1 | 0 | 0 |" in pool.report and "- e: 1" in pool.report
    talks = spark.createDataFrame([(i, [("human", "h"), ("gpt", "g")]) for i in range(3)], "ord bigint, conversations array<struct<from:string,value:string>>")
    made = P.build_finetuning(train, pool.clean, talks, 0.5)
    assert sorted(r["origin"] for r in made.collect()) == ["general", "main"]


def test_preferences(spark):
    samples = spark.createDataFrame([("s", "t", "q", "a", {"A": "1", "B": "2"}, None)], SAMPLE)
    good = spark.createDataFrame([("s", ["答案:A", "答案:B"])], "id string, solutions array<string>")
    assert P.build_preferences(samples, good, prompt="Q {}").first()["messages"][0]["content"].startswith("Q q\nA. 1")
    with pytest.raises(AssertionError):
        P.build_preferences(samples, good.limit(0))


def test_chat(spark):
    samples = spark.createDataFrame([("a", "t", "q", "x", {"A": "1"}, None), ("b", "t", "boom", "x", None, None), ("c", "t", "r", "x", None, None)], SAMPLE)

    def make():
        def client(prompt, n):
            if "boom" in prompt:
                raise ValueError("no")
            return [f"{prompt}!{i}" for i in range(n)]

        return client

    done = spark.createDataFrame([("c",)], "id string")
    got = {r["id"]: (r["solutions"], r["error"]) for r in P.sample_solutions(samples, done, make, n=2, count=10, prompt="<{}>").collect()}
    assert got == {"a": (["<q\nA. 1>!0", "<q\nA. 1>!1"], None), "b": (None, "ValueError: no")}
    asked = spark.createDataFrame([("a", "q", "g", "o"), ("b", "boom", "g", None)], "id string, question string, gold string, output string")

    def judge():
        def client(prompt, n):
            return ['{"correct": true}' if prompt == "q|g|o" else "?"]

        return client

    assert {r["id"]: r["correct"] for r in chat.judged(asked, judge, "{question}|{gold}|{output}").collect()} == {"a": True, "b": None}


def test_evaluation_and_export(spark):
    samples = spark.createDataFrame([("x-1", "x", "q", "A", {"A": "1", "B": "2"}, None), ("x-2", "x", "q", "B", {"A": "1", "B": "2"}, None), ("y-1", "y", "q", "a", None, None)], SAMPLE)
    outputs = spark.createDataFrame([("x-1", "答案:A"), ("x-2", "答案:A")], "id string, output string")
    graded, tally = P.evaluate_run(samples, outputs, "base")
    assert {r["set_name"]: (r["n"], r["correct"], r["abstained"]) for r in tally.collect()} == {"x": (2, 1, 0), "y": (1, 0, 1)}
    answers = graded.join(outputs, "id", "left")
    both = answers.unionByName(answers.replace("base", "tuned", "run"))
    summary, shown = P.export_replay(samples, both, "base", ["tuned"], None)
    assert summary.where("run = 'base' and set_name = 'x'").first()["acc"] == 50.0
    texts = [json.loads(r["question_json"]) for r in shown.collect()]
    assert {t["id"]: t["bucket"] for t in texts} == {"x-1": "all_correct", "x-2": "all_wrong", "y-1": "all_correct"}
    labelled = samples.join(outputs, "id").selectExpr("id", "gold", "options", "output", "true as human_correct")
    r = P.calibrate(labelled).first()
    assert (r["total"], r["agree"], r["disagree"]) == (2, 1, 1)
    assert P.calibration_sample(samples, 1, 1).count() == 2


def test_load_report(spark):
    rows = [("a", 1, 10, 0, 80.0, 90.0, 6.0, 7.0, 100.0, 0.5, 1.0), ("b", 1, 10, 0, 70.0, 80.0, 5.0, 6.0, 120.0, 0.6, 1.0), ("b", 2, 0, 3, None, None, None, None, None, None, 1.0)]
    s = spark.createDataFrame(rows, "label string, concurrency int, requests int, failed int, ttft_p50 double, ttft_p95 double, tpot_p50 double, tpot_p95 double, output_tok_s double, req_per_s double, wall_s double")
    text = P.load_report(s, "a", "b")
    assert "| a | 1 | 80.0 / 90.0 | 6.0 | 100.0 | 0.500 | 0 |" in text and "(+20 %)" in text and "| b | 2 | — / — |" in text
    with pytest.raises(AssertionError):
        P.load_report(s.limit(0), "a", "b")
