import pytest

from corpuloom.sources import adapters


def rows(df):
    return {r["id"]: r.asDict(recursive=True) for r in df.collect()}


def exam(spark, answer, options='[{"key":"A","value":" x "},{"key":"B","value":"y"},{"key":"C","value":"z"},{"key":"D","value":"w"}]'):
    return adapters.cmexam(spark.createDataFrame([(0, " q ", options, answer)], "ord bigint, Question string, Options string, Answer string"), "cmexam-test")


@pytest.mark.parametrize("answer,gold", [("A，C", "AC"), ("c;a", "AC"), ("DBA", "ABD"), ("B", "B"), ("A/B、C", "ABC"), ("AA", "A")])
def test_gold(spark, answer, gold):
    good, bad = exam(spark, answer)
    r = rows(good)["cmexam-test-0"]
    assert (r["gold"], r["question"], r["options"]["A"], bad.count()) == (gold, "q", "x", 0)


@pytest.mark.parametrize("answer", ["", None, "E", "AZ", "A；B", "x"])
def test_quarantine(spark, answer):
    good, bad = exam(spark, answer)
    assert good.count() == 0 and bad.first()["ord"] == 0


def test_option_forms(spark):
    good, _ = exam(spark, "F", '{"A":"1","F":"6"}')
    assert rows(good)["cmexam-test-0"]["gold"] == "F"
    good, _ = exam(spark, "A", '[{"key":"A","value":"1"},{"key":" A","value":"2"}]')  # the last one wins
    assert rows(good)["cmexam-test-0"]["options"] == {"A": "2"}
    wide = spark.createDataFrame([(3, "q", "1", "2", None, "", "B")], "ord bigint, Question string, A string, B string, C string, D string, Answer string")
    assert rows(adapters.cmexam(wide, "cmexam-val")[0])["cmexam-val-3"]["options"] == {"A": "1", "B": "2"}


def test_missing_fields(spark):
    with pytest.raises(KeyError, match="Answer"):
        adapters.cmexam(spark.createDataFrame([(0, "q")], "ord bigint, Question string"))
    with pytest.raises(KeyError, match="option columns"):
        adapters.cmexam(spark.createDataFrame([(0, "q", "A")], "ord bigint, Question string, Answer string"))
    with pytest.raises(TypeError):
        adapters.cmexam(spark.createDataFrame([(0, "q", "A", 1)], "ord bigint, Question string, Answer string, Options int"))
    with pytest.raises(KeyError, match="unknown source"):
        adapters.adapt(spark.range(1), "nothing")


def test_open_sources(spark):
    df = spark.createDataFrame([(0, " q ", "\u3000g"), (2, None, "g")], "ord bigint, `Open-ended Verifiable Question` string, `Ground-True Answer` string")
    good, bad = adapters.adapt(df, "med-o1-verifiable")
    assert rows(good)["med-o1-verifiable-0"] | {"meta": {}} == {"ord": 0, "id": "med-o1-verifiable-0", "source": "med-o1-verifiable", "question": "q", "gold": "g", "options": None, "cot": None, "meta": {}}
    assert [r["ord"] for r in bad.collect()] == [2]
    df = spark.createDataFrame([(1, "q", "r", "a")], "ord bigint, question string, `reasoning (reasoning_content)` string, `response (content)` string")
    assert rows(adapters.adapt(df, "med-r1-zh")[0])["med-r1-zh-1"]["cot"] == "r"
    df = spark.createDataFrame([(1, "q", "r", "a")], "ord bigint, Question string, Complex_CoT string, Response string")
    assert rows(adapters.adapt(df, "med-o1-sft-zh")[0])["med-o1-sft-zh-1"]["gold"] == "a"


def test_map_sources(spark):
    df = spark.createDataFrame([(0, "q", {"A": "1", "B": " ", "F": "3"}, "FA", "内科")], "ord bigint, question string, option map<string,string>, answer string, exam_subject string")
    r = rows(adapters.adapt(df, "cmb-val")[0])["cmb-val-0"]
    assert (r["gold"], r["options"], r["meta"]) == ("AF", {"A": "1", "F": "3"}, {"exam_subject": "内科", "question_type": ""})
    df = spark.createDataFrame([(0, "q", {"A": "", "J": "x"}, "j")], "ord bigint, question string, options map<string,string>, label string")
    r = rows(adapters.adapt(df, "medxpertqa")[0])["medxpertqa-0"]
    assert (r["gold"], r["options"]) == ("J", {"A": "", "J": "x"})


def test_counts_of_dropped(spark):
    df = spark.createDataFrame([(i, "q", '{"A":"1"}', "B") for i in range(5)], "ord bigint, Question string, Options string, Answer string")
    _, bad = adapters.cmexam(df, "cmexam-val")
    assert [tuple(r) for r in adapters.drop_counts(bad).collect()] == [("cmexam-val", 5)]
    assert sorted(r["ord"] for r in adapters.first_dropped(bad).collect()) == [0, 1, 2]
