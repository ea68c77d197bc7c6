import random

import pytest
from pyspark.sql import functions as F

from corpuloom.operators import grading as G
from corpuloom.operators import sampling as S
from corpuloom.sources.adapters import render_question

SAMPLE = "id string, gold string, options map<string,string>, question string"


def verdicts(spark, rows):
    samples = spark.createDataFrame([(str(i), g, o, "q") for i, (g, o, _, _) in enumerate(rows)], SAMPLE)
    outputs = spark.createDataFrame([(str(i), t) for i, (_, _, t, _) in enumerate(rows)], "id string, output string")
    return {int(r["id"]): r["correct"] for r in G.grade(samples, outputs).collect()}


AB = {"A": "x", "B": "y", "C": "z"}


def test_rule_verdicts(spark):
    rows = [
        ("AC", AB, "\\boxed{CA}", True), ("AC", AB, "\\boxed{A}", False), ("A", AB, "不知道", None), ("肺炎", None, "最终答案:肺炎", True), ("肺炎", None, "最终答案:肺炎，需结合影像", None), ("肺炎", None, "最终答案:肺炎,需结合影像", True),
        ("布洛芬", None, "最终答案:右布洛芬", None), ("肺炎", None, "最终答案:不是肺炎", None), ("", None, "最终答案:肺炎", None), ("肺 炎", None, "\\boxed{肺炎。}", True), ("A", {}, "答案:A", True),
    ]
    assert verdicts(spark, rows) == {i: w for i, (*_, w) in enumerate(rows)}


def test_judge_and_missing(spark):
    samples = spark.createDataFrame([("a", "A", AB, "q"), ("b", "肺炎", None, "q"), ("c", "x", None, "q"), ("d", "x", None, "q")], SAMPLE)
    outputs = spark.createDataFrame([("a", "答案:B"), ("b", "最终答案:别的"), ("d", "没有")], "id string, output string")
    judged = spark.createDataFrame([("a", True), ("b", True), ("d", None)], "id string, correct boolean")
    got = {r["id"]: (r["correct"], r["method"]) for r in G.grade(samples, outputs, judged).collect()}
    assert got == {"a": (False, "rule"), "b": (True, "llm"), "c": (None, "missing"), "d": (None, "llm")}
    assert [r["id"] for r in G.judge_prompts(samples, outputs).orderBy("id").collect()] == ["b", "d"]


def test_solution_classes(spark):
    rows = spark.createDataFrame([("肺炎", "肺炎", None), ("肺炎", "胃炎", True), ("肺炎", "胃炎", False), ("肺炎", "胃炎", None), ("肺炎", None, True)], "gold string, declaration string, arbiter boolean")
    none = F.lit(None).cast("map<string,string>")
    got = rows.select(G.solution_class(F.col("gold"), none, F.col("declaration")), G.solution_class(F.col("gold"), none, F.col("declaration"), F.col("arbiter"))).collect()
    assert [tuple(r) for r in got] == [("correct", "correct"), ("wrong", "correct"), ("wrong", "wrong"), ("wrong", "drop"), ("drop", "drop")]


def test_pairs(spark):
    classes = [("p", 0, "长长长对", "correct"), ("p", 1, "对", "correct"), ("p", 2, "对对", "correct"), ("p", 3, "错", "wrong"), ("q", 0, "对", "correct"), ("r", 0, "错", "wrong"), ("s", 0, "a", "correct"), ("s", 1, "x", "wrong"), ("s", 2, "y", "wrong"), ("s", 3, "z", "drop"), ("s", 4, "b", "correct")]
    made = G.pairs(spark.createDataFrame(classes, "id string, i int, solution string, cls string"))
    got = sorted((r["id"], r["rank"], r["chosen"], r["rejected"]) for r in made.collect())
    assert [g[:3] for g in got] == [("p", 1, "对"), ("p", 2, "对对"), ("s", 1, "a"), ("s", 2, "b")]
    assert [g[3] for g in got[:2]] == ["错", "错"] and {g[3] for g in got[2:]} == {"x", "y"}
    again = G.pairs(spark.createDataFrame(classes[::-1], "id string, i int, solution string, cls string").repartition(7))
    assert sorted((r["id"], r["rank"], r["chosen"], r["rejected"]) for r in again.collect()) == got


def test_records_and_labels(spark):
    samples = spark.createDataFrame([("s", "a", {"B": "2", "A": "1"}, "q")], SAMPLE)
    dpo = spark.createDataFrame([("s", ["答案:A", None, "答案:B"]), ("s", ["答案:A", None, "答案:B"]), ("n", None), ("e", [])], "id string, solutions array<string>")
    classes = G.classified(dpo, samples)
    assert sorted((r["i"], r["cls"]) for r in classes.collect()) == [(0, "correct"), (2, "wrong")]
    row = G.pair_records(G.pairs(classes), samples, "题:{}!").first()
    assert row["messages"][0]["content"] == "题:q\nA. 1\nB. 2!" and row["rejected_response"] == "答案:B"
    labels = spark.createDataFrame([("s#2", "correct")], "key string, cls string")
    assert sorted((r["i"], r["cls"]) for r in G.classified(dpo, samples, labels).collect()) == [(0, "drop"), (2, "correct")]


def test_messages(spark):
    df = spark.createDataFrame([("b", "q", "c", "g"), ("a", "q", "c", "g"), ("d", "q", "", "g"), ("e", "q2", None, "g"), ("f", "q3", "c", "g")], "id string, question string, cot string, gold string")
    made = G.reasoning_rows(df, df.where("id <> 'f'"))
    assert [(r["id"], r["messages"][1]["content"]) for r in made.collect()] == [("a", "<think>\nc\n</think>\n\ng")]
    talk = "ord bigint, conversations array<struct<from:string,value:string>>"
    rows = [(0, [("human", " h "), ("gpt", "g\n")]), (1, [("human", "h")]), (2, [("gpt", "g"), ("human", "h")]), (3, None), (4, [("human", "h"), ("gpt", "g"), ("human", "h")])]
    got = G.single_turn(spark.createDataFrame(rows, talk)).collect()
    assert [(r["ord"], [m["content"] for m in r["messages"]]) for r in got] == [(0, ["h", "g"])]


def test_calibration(spark):
    rows = [(True, True)] * 57 + [(False, True)] * 2 + [(None, True)] * 10 + [(False, None)]
    r = G.calibration(spark.createDataFrame(rows, "correct boolean, human_correct boolean")).first()
    assert (r["total"], r["judged"], r["agree"], r["disagree"], r["abstain"], r["fit"]) == (70, 60, 58, 2, 10, True)
    assert not G.calibration(spark.createDataFrame(rows[:20], "correct boolean, human_correct boolean")).first()["fit"]
    assert G.calibration(spark.createDataFrame([], "correct boolean, human_correct boolean")).first()["rate"] == 0


def test_render(spark):
    df = spark.createDataFrame([("q", {"B": "2", "A": None}), ("q", {}), ("q", None)], "q string, o map<string,string>")
    assert [r[0] for r in df.select(render_question(F.col("q"), F.col("o"))).collect()] == ["q\nA. \nB. 2", "q", "q"]


def test_sampling(spark):
    df = spark.createDataFrame([(f"k{i}", i % 3) for i in range(100)], "k string, g int")
    first = [r["k"] for r in S.sample(df, "k", 30).orderBy("pos").collect()]
    assert first[10:20] == [r["k"] for r in S.sample(df.repartition(9), "k", 10, offset=10).orderBy("pos").collect()]
    assert {r["g"]: r["count"] for r in S.sample(df, "k", 5, by=["g"]).groupBy("g").count().collect()} == {0: 5, 1: 5, 2: 5}
    assert S.sample(df, "k", 500).count() == 100
    ordered = df.withColumn("ord", F.substring("k", 2, 9).cast("bigint"))
    assert [r["ord"] for r in S.compat_sample(ordered, "ord", 100, 7).orderBy("pos").collect()] == random.Random(42).sample(range(100), 7)


def test_mix(spark):
    main, general = spark.range(850).select(F.col("id").cast("string").alias("key")), spark.range(500).select(F.col("id").cast("string").alias("key"))
    mixed = S.ratio_mix(main, general, "key", 0.15)
    counts = {r["origin"]: r["count"] for r in mixed.groupBy("origin").count().collect()}
    assert counts == {"main": 850, "general": 150}
    with pytest.raises(ValueError):
        S.ratio_mix(main, general.limit(1), "key", 0.5)
    prompts = spark.createDataFrame([(0, "a"), (1, "b")], "ord bigint, p string")
    assert [r["p"] for r in S.round_robin(prompts, 5).orderBy("i").collect()] == list("ababa")
    assert S.parse_sizes("a=2, b=30") == {"a": 2, "b": 30}
