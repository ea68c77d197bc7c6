import json
import os

import pytest

from corpuloom.sources import readers as R
from corpuloom.streaming import resume


def test_lines_and_jsonl(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"id":"a","output":"1"}\n\n{"id":"b","output":null}\n{"id":"a","output":"2"}\n', encoding="utf-8")
    rows = R.read_jsonl(spark, str(f), "id string, output string")
    assert [tuple(r) for r in rows.orderBy("ord").collect()] == [(0, "a", "1"), (2, "b", None), (3, "a", "2")]
    assert sorted(tuple(r)[1:] for r in R.last_wins(rows, "id").collect()) == [("a", "2"), ("b", None)]
    assert [tuple(r) for r in R.missing_fields(R.read_lines(spark, str(f)), ["id", "x"]).where("ord = 0").collect()] == [(0, ["x"])]


def test_documents(spark, tmp_path):
    for n in ("b", "a"):
        (tmp_path / f"bench-{n}.json").write_text(json.dumps({"label": n, "levels": [{"concurrency": 1}]}))
    got = R.read_json_documents(spark, str(tmp_path / "bench-*.json"), "label string, levels array<struct<concurrency:bigint>>")
    assert [(r["file"], r["label"]) for r in got.orderBy("file").collect()] == [("bench-a.json", "a"), ("bench-b.json", "b")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", None), (0, "a", "x")], "ord int, id string, v string")
    R.write_jsonl(df, str(tmp_path / "out"), "ord")
    lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [{"id": "a", "v": "x"}, {"id": "b", "v": None}]
    for _ in range(2):
        R.append_checkpoint(df, str(tmp_path / "cp"))
    assert spark.read.json(str(tmp_path / "cp")).count() == 4
    R.write_report(str(tmp_path / "r" / "x.md"), "# x")
    assert (tmp_path / "r" / "x.md").read_text() == "# x"


def test_fetch_and_settings(spark, tmp_path):
    known = {"good": lambda: spark.range(1), "bad": lambda: 1 / 0}
    frames, errors = R.fetch_all(["good", "bad"], known)
    assert list(frames) == ["good"] and "ZeroDivisionError" in errors["bad"]
    with pytest.raises(KeyError):
        R.fetch_all(["none"], known)
    (tmp_path / ".env").write_text("# c\nCL_A=1\nCL_B=2\nbroken\nCL_C=\n")
    os.environ["CL_A"] = "kept"
    assert R.load_env(str(tmp_path / ".env")) == {"CL_A": "1", "CL_B": "2"} and os.environ["CL_A"] == "kept"
    with pytest.raises(AssertionError):
        R.gate(False, "no")


def test_resume(spark, tmp_path):
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    done = spark.createDataFrame([("b",), ("b",)], "id string")
    assert sorted(r["id"] for r in resume.remaining(work, done).collect()) == ["a", "c"]
    assert resume.bounded(work, 3).rdd.getNumPartitions() == 3
    src, target = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for n, ids in enumerate((["a", "b", "a"], ["b", "c"])):
        (src / f"{n}.json").write_text("".join(json.dumps({"id": i}) + "\n" for i in ids))
        q = resume.follow(spark, str(src), "id string", "id", target, str(tmp_path / "state"), lambda d: d)
        q.awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]
