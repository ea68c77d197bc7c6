"""Operators of reports, sources and preference data on small cases."""

import json
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpuloom.functions.extract import first_declared
from corpuloom.operators import evaluation as E
from corpuloom.operators import grading as G
from corpuloom.operators import loadtest as L
from corpuloom.sources import readers as R


def test_lines_of_many_files(spark, tmp_path):
    want = []
    for n in ("b", "a", "c"):
        (tmp_path / f"{n}.txt").write_text("".join(f"{n}{i}\n" if i % 4 else "\n" for i in range(300)), encoding="utf-8")
    for n in ("a", "b", "c"):
        want += [f"{n}{i}" if i % 4 else "" for i in range(300)]
    got = [tuple(r) for r in R.read_lines(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == list(enumerate(want))


def test_scored_labels_and_rewrite(spark, tmp_path):
    f = tmp_path / "s.jsonl"
    f.write_text('{"id":"a","correct":true,"method":"rule"}\n\n{"id":"b","correct":null,"method":"llm"}\n{"id":"c","method":"abstain"}\n{"id":"d","correct":false}\n')
    assert {r["id"]: (r["correct"], r["method"]) for r in R.load_scored(spark, str(f)).collect()} == {"a": (True, "rule"), "b": (None, "llm"), "c": (None, "abstain"), "d": (False, None)}
    g = tmp_path / "h.jsonl"
    g.write_text(json.dumps({"sample": {"id": "q", "source": "s", "question": "?", "gold": "A", "options": {"A": "x"}}, "output": "答案:A", "human_correct": True}) + "\n\n")
    row = R.load_human_labels(spark, str(g)).first()
    assert (row["id"], row["options"], row["output"], row["human_correct"], row["cot"]) == ("q", {"A": "x"}, "答案:A", True, None)
    path = str(tmp_path / "w")
    R.rewrite(spark.createDataFrame([(1, None)], "a int, b string"), path)
    for _ in range(2):  # reads what it replaces
        R.rewrite(spark.read.schema("a int, b string").json(path).withColumn("a", F.col("a") + 1), path)
    assert [tuple(r) for r in spark.read.schema("a int, b string").json(path).collect()] == [(3, None)]


def test_python_draws(spark):
    random.seed(8)
    classes = [(f"q{q}", i, random.choice("ab") * random.randint(1, 9) + str(i), random.choice(["correct", "wrong", "wrong", "drop"])) for q in range(60) for i in range(6)]
    want = {}
    for q in sorted({c[0] for c in classes}):
        right = sorted((c[2] for c in classes if c[0] == q and c[3] == "correct"), key=len)[:2]
        wrong = [c[2] for c in classes if c[0] == q and c[3] == "wrong"]
        if right and wrong:
            rng = random.Random(42 + zlib.crc32(q.encode()) % 10000)
            drawn = rng.sample(wrong, len(right)) if len(wrong) >= len(right) else [rng.choice(wrong) for _ in right]
            want |= {(q, k + 1): (c, r) for k, (c, r) in enumerate(zip(right, drawn))}
    made = G.pairs_compat(spark.createDataFrame(classes, "id string, i int, solution string, cls string").repartition(3))
    assert {(r["id"], r["rank"]): (r["chosen"], r["rejected"]) for r in made.collect()} == want and len(want) > 40


def test_arbitration(spark):
    samples = spark.createDataFrame([("p", "q?", "肺炎", None)], "id string, question string, gold string, options map<string,string>")
    dpo = spark.createDataFrame([("p", ["最终答案:肺炎", "最终答案:肺部感染", "最终答案:胃炎", "最终答案:肾炎", "没有"])], "id string, solutions array<string>")
    assert sorted(r["key"] for r in G.to_arbitrate(dpo, samples).collect()) == ["p#1", "p#2", "p#3"]
    words = spark.createDataFrame([("p#1", True), ("p#2", False), ("p#3", None)], "key string, correct boolean")
    assert {r["i"]: r["cls"] for r in G.classified(dpo, samples, arbitrated=words).collect()} == {0: "correct", 1: "correct", 2: "wrong", 3: "drop", 4: "drop"}
    from corpuloom.plans.pipelines import build_preferences

    made = build_preferences(samples, dpo, arbitrated=words).collect()
    assert len(made) == 2 and {r["rejected_response"] for r in made} == {"最终答案:胃炎"}


def test_shown_answers(spark):
    cases = {"答案：C，因为": "C", "最终答案是 A、B 和 D。": "ABD", "答案:AB": None, "The answer is (c)": "C", "answer: B then answer: C": "B", "没有": None, "答案ABC1": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r[0]: r[1] for r in rows.select("t", first_declared(F.col("t"))).collect()}
    js = re.compile(r"(?:最终答案|正确答案|答案)\s*(?:是|为|[:：])?\s*([A-J](?:\s*[、,，和\s]\s*[A-J])*)(?![A-Za-z0-9])")
    for text, shown in got.items():
        m = js.search(text)
        en = re.search(r"(?:the answer is|answer\s*:)\s*\(?([A-J])\)?", text, re.I)
        assert shown == (re.sub(r"[\s、,，和]", "", m[1]) if m else en[1].upper() if en else None), text


def test_replay_parts(spark):
    q = spark.createDataFrame([("s", "1", "mixed"), ("t", "2", "mixed"), ("s", "3", "dpo_fix")], "set_name string, id string, bucket string")
    assert E.filtered(q).count() == 3 and [r["id"] for r in E.filtered(q, "s", "mixed").collect()] == ["1"] and E.filtered(q, "s").count() == 2
    assert [tuple(r) for r in E.buckets_present(q).orderBy("place").collect()] == [(1, "dpo_fix"), (2, "mixed")]
    out = spark.createDataFrame([("1", "a", "x"), ("2", "a", "y")], "id string, run string, output string")
    scored = spark.createDataFrame([("1", "a", True, "rule"), ("9", "a", True, "rule")], "id string, run string, correct boolean, method string")
    assert {r["id"]: (r["correct"], r["method"]) for r in E.with_verdicts(out, scored).collect()} == {"1": (True, "rule"), "2": (None, None)}
    samples = spark.createDataFrame([("1", "src", "q", {"A": "x"}, "A", {"m": "v"})], "id string, source string, question string, options map<string,string>, gold string, meta map<string,string>")
    r = E.replay(q, samples, E.with_verdicts(out, scored), labels={"mixed": "various"}).first()
    assert (r["set_name"], r["label"], r["meta"], r["answers"]["a"]["correct"]) == ("s", "various", {"m": "v"}, True)


def test_bench_record(spark):
    one = spark.createDataFrame([(4, 12, 0, 1.5, None, 2.0, 3.0, 100.0, 0.5, 9.0), (1, 12, 1, None, None, None, None, None, None, 1.0)], "concurrency int, requests int, failed int, ttft_p50 double, ttft_p95 double, tpot_p50 double, tpot_p95 double, output_tok_s double, req_per_s double, wall_s double")
    d = json.loads(L.bench_record(one, "x", "m", "g", 256).first()["record"])
    assert (d["label"], d["max_tokens"], [v["concurrency"] for v in d["levels"]], d["levels"][0]["ttft_p50"]) == ("x", 256, [1, 4], None)


def test_intervals_the_other_way(spark):
    t = spark.createDataFrame([("base", "s", 0.5, 0.4, 0.6), ("a", "s", 0.55, 0.51, 0.6), ("b", "s", 0.7, 0.6, 0.8), ("c", "s", 0.3, 0.2, 0.55), ("d", "t", 0.3, 0.2, 0.4)], "run string, set_name string, acc double, ci_low double, ci_high double")
    assert {r["run"]: r["delta_class"] for r in E.within_base(t, "base").collect()} == {"base": None, "a": "flat", "b": "up", "c": "down", "d": None}


def test_grades_against_another_reading(spark):
    """Every answer of the smallest tables, read by plain regular expressions on the driver."""
    import os

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no tables here")
    from corpuloom.plans.queries import QUERIES

    letter = r"[A-J](?![A-Za-z0-9\u4e00-\u9fff])"
    kinds = [
        re.compile(r"\\boxed\{((?=[^{}]*[A-Ja-j])[A-Ja-j\s、,和]+)\}"),
        re.compile(rf"(?:最终答案|正确答案|答案|(?<![不别勿莫误错])故选|(?<![不别勿莫误错])应选)\s*(?:是|为|:)?\s*[*\s「【\[(]*({letter}(?:\s*[、,和\s]\s*{letter})*)"),
        re.compile(r"(?:the\s+answer\s+is|answer\s*:)\s*[*\s]*\(?([A-Ja-j])\)?(?![A-Za-z0-9])", re.I),
    ]

    def norm(t):
        return "".join(c for c in t if c.isalnum()).lower()

    def read(output, choice):
        if output is None:
            return None
        tail = re.sub(r"\\(?:text|mathrm|mathbf)\{([^{}]*)\}", r"\1", output[-2000:])
        if choice:
            found = max(((m.start(), m[1]) for k in kinds for m in k.finditer(tail)), default=None)
            return "".join(sorted(set(re.sub("[^A-J]", "", found[1].upper())))) or None if found else None
        boxed = re.findall(r"\\boxed\{([^{}]+)\}", tail)
        line = re.findall(r"(?:最终答案|答案)\s*(?:是|为|:)\s*(.+)", tail)
        text = boxed[-1] if boxed else line[-1] if line else None
        return re.sub(r"[。.」】]+\Z", "", text.strip()) or None if text is not None else None

    def verdict(gold, choice, d):
        if d is None:
            return None
        if choice:
            return d == "".join(sorted(set(gold.upper())))
        return True if norm(gold) and norm(gold) in (norm(d), norm(re.split("[,。;!?]", d)[0])) else None

    texts = {r["out_id"]: r["output"] for r in spark.read.parquet(f"{data}/outputs.parquet").select("out_id", "output").collect()}
    rows = QUERIES["grade_outputs"](spark, data).collect()
    assert len(rows) > 100
    for r in rows:
        d = read(texts[r["out_id"]], r["options"] is not None)
        assert (r["declaration"], r["correct"]) == (d, verdict(r["gold"], r["options"] is not None, d)), texts[r["out_id"]]
