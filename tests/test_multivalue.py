import json
import random

from corpuloom.operators.multivalue import explode_values

SCHEMA = "row_no bigint, options string, answer string, pos int"


def run(spark, rows, schema=SCHEMA):
    out = {}
    for r in explode_values(spark.createDataFrame(rows, schema)).orderBy("row_no", "pos").collect():
        out.setdefault(r["row_no"], []).append(r["value"])
    return out


OPTIONS = ["阿司匹林", "头痛、恶心", "1,23-二羟A", '所谓"头痛"型', "范围47mm，更大", "65mg/d药", "综合征(CT)"]
OBJECT = json.dumps(dict(zip("ABCDEFG", OPTIONS)), ensure_ascii=False)
LISTED = json.dumps([{"key": k, "value": v} for k, v in zip("ABCDEFG", OPTIONS)], ensure_ascii=False)


def test_letters(spark):
    cases = {
        "A,B": "AB", "ABD": "ABD", "a、 c": "AC", "Ａ；Ｂ": "AB", '"A,C"': "AC", '"A","B"': "AB", '["A", "B"]': "AB", "[A] [B] [C] ": "ABC", "(A)(B)": "AB", "A和B和C": "ABC",
        "A,,B": "AB", "A,，B": "AB", "  A / B\n": "AB", "答案:A&B": "AB", "正确答案 A|B": "AB", "A;B;A": "ABA", "A、B。": "AB", "'A'、'B'": "AB", "A+B&C；D/E": "ABCDE", "「A」，“B”": "AB", "A.B": "AB", "A\tB\nC": "ABC",
    }
    got = run(spark, [(i, OBJECT, a, 9) for i, a in enumerate(cases)])
    assert [("".join(got.get(i, []))) for i in range(len(cases))] == list(cases.values())


def test_texts(spark):
    cases = {
        "阿司匹林；头痛、恶心": [0, 1], '"头痛、恶心"，阿司匹林': [1, 0], '“1,23-二羟A”|"所谓""头痛""型"': [2, 3], "范围47mm，更大\t65mg/d药": [4, 5], "「综合征(CT)」 ; 阿司匹林;阿司匹林": [6, 0, 0],
        "答案：阿司匹林、综合征(CT)。": [0, 6], "阿司匹林/65mg/d药": [0, 5],
    }
    for options in (OBJECT, LISTED):
        got = run(spark, [(i, options, a, 9) for i, a in enumerate(cases)])
        assert [got.get(i) for i in range(len(cases))] == [[OPTIONS[k] for k in v] for v in cases.values()]


def test_no_rows(spark):
    cases = [None, "", " ", "?", "略", "X", "A", "“A”", "A。", "阿司匹林", '"头痛、恶心"', "1,23-二羟A", '"所谓""头痛""型"', "未知药;另一药"]
    assert run(spark, [(i, OBJECT, a, 9) for i, a in enumerate(cases)]) == {}


def test_bad_options_and_repeats(spark):
    rows = [(1, None, "A,B", 9), (1, None, "A,B", 9), (2, "{broken", "B;C", 9), (3, "[]", "甲;乙", 9), (None, OBJECT, "A,B", 9)]
    assert run(spark, rows) == {1: ["A", "B"], 2: ["B", "C"], None: ["A", "B"]}
    assert run(spark, []) == {}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, OBJECT, "A,B", 7, "x")], "row_no bigint, options string, answer string, pos int, value string")
    assert [tuple(r) for r in explode_values(df).orderBy("pos").collect()] == [(1, 1, "A"), (1, 2, "B")]


def test_very_long_field(spark):
    assert len(run(spark, [(1, OBJECT, "阿司匹林;" * 20_000, 0)])[1]) == 20_000


def test_against_generator(spark):
    """Written values come back, for random values, quotes and delimiters."""
    random.seed(3)
    rows, want = [], {}
    for i in range(300):
        picked = [random.choice(OPTIONS) for _ in range(random.randint(2, 5))]
        written = []
        for v in picked:
            a, b = random.choice([('"', '"'), ("“", "”"), ("「", "」")])
            doubled = v.replace('"', '""') if a == '"' else v
            quoted = '"' in v or random.random() < 0.5
            written.append(f'"{v.replace(chr(34), chr(34) * 2)}"' if '"' in v else f"{a}{doubled}{b}" if quoted else v)
        rows.append((i, random.choice([OBJECT, LISTED]), random.choice(["；", ";", "|", "\t", "\n", " ; ", "，", ","]).join(written), 0))
        want[i] = picked
    assert run(spark, rows) == want
