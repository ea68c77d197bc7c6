from corpuloom.llm import answers as A

ZH = "患者男，45岁，因胸痛、呼吸困难3天就诊，血压120/80mmHg，最可能的诊断是什么？"
EN = "A 45-year-old man presents with chest pain and dyspnea for three days; which is the best diagnosis?"

OUTPUTS = "out_id bigint, run_name string, set_name string, id string, output string, defect string, source string"
DPO = "id string, solutions array<string>, pos int"
SAMPLES = "id string, source string, question string, gold string, options map<string,string>, cot string, meta map<string,string>"


def test_empty():
    for t in (None, "", " \n", "​", "无", "N/A", "null", "-", "...", "。", "答案:", "Answer:", "<think></think>\n\n", "<think>\n\n</think>", "最终答案："):
        assert A.is_empty(t), t
    for t in ("A", "答案:B", "无明显异常", "炎症。", "\\boxed{C}", "不", "no fracture"):
        assert not A.is_empty(t), t


def test_endings():
    whole = [
        "推理完成。", "It is done.", "推理。\n答案:C", "推理。\n**答案:D**", "推理。\n【答案】AB", "\\boxed{E}", "x\nThe answer is (B).", "I would choose AE.", "Answer: J", "答案是 D", "故选E。", "综上，正确答案为A。", "→ C",
        "**最终答案:胃穿孔**", "\\boxed{胃穿孔}", "C", "说完了？", "他说“好。”", "", "完了。\n```",
    ]
    open_ = ["推理到一半，然后", "推理。\n1. 第一步", "推理。\n2.", "x. the patient with hemo", "推理。\n答案:", "推理。\n\\boxed{C", "血压12，", "因为，", "推理。\n（见", "推理。 然�", "（" + "长" * 900, "推理。\n答案（" + "长" * 900]
    final = ["**Answer:** cochlear fibrosis", "最终答案：弥漫性股骨头穿孔", "推理。\n最终答案：弥漫性股骨头", "Final answer: coch", "最终答案:某综合"]
    for want, texts in ((A.WHOLE, whole), (A.OPEN, open_), (A.FINAL, final), (A.ALONE, ["胃穿孔", "血压正常因此头", "the patient with"])):
        for t in texts:
            assert A.ending(t) == want, t
    assert A.ending("因此晕厥" * 30) == A.OPEN  # no short answer


def test_vocabulary_against_brute_force(spark):
    import random

    from corpuloom.llm import vocabulary as V

    random.seed(6)
    signs = "abcＡ胃穿孔炎症 ，.1\n"
    texts = ["".join(random.choices(signs, k=random.randint(0, 12))) for _ in range(300)] + [None, "", "终" * 5000]
    known, ends, node = set(), set(), set()
    for t in texts:
        t = (t or "").rstrip(V.INVISIBLE).lower().replace("ａ", "a")
        for i, c in enumerate(t):
            for k in range(1, 20):
                w, nxt = t[i : i + k], t[i + k : i + k + 1]
                if len(w) < k:
                    break
                latin = all(x in "abc" for x in w) and (i == 0 or t[i - 1] not in "abc")
                han = all(x in "胃穿孔炎症终" for x in w) and (k == 2 or k == 1 and (i == 0 or t[i - 1] not in "胃穿孔炎症终"))
                if latin and nxt:
                    (node if nxt in "abc" else known).add(w)
                    if nxt in "，.\n":
                        ends.add(w)
                if han and nxt:
                    more = nxt in "胃穿孔炎症终"
                    if k == 2 and more:
                        node.add(w)
                    if nxt in "，.\n":
                        known.add(w)
                        ends.add(w)
    asked = sorted({V.last_word(x) for x in {t[: random.randint(1, 12)].lower().replace("ａ", "a") for t in texts if t}} - {""})
    hashes = dict(zip(V.word_hashes(asked), asked))
    rows = V.looked_up(spark.createDataFrame([(h,) for h in (*hashes, None)], "word bigint"), spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    got = {hashes[r["word"]]: (r["known"], r["ends"], r["node"]) for r in rows if r["word"] in hashes}
    for w in asked:
        assert got.get(w, (False, False, False)) == (w in known, w in ends, w in node), w
    assert V.last_word("见 hemoｒrha") == "hemoｒrha" and V.last_word("12胃穿孔") == "穿孔" and V.last_word("12%") == "" == V.last_word("")


def test_held_out_refusals():
    """Phrasings that the tables do not have."""
    refused = [
        "很抱歉，我无法解答您的这个提问。", "作为助手，我不适合就用药问题给出判断。", "这道题我没法帮你做出选择。", "恕难奉告。", "根据规定，我无权对病情提供意见。", "请谅解，我不愿就此题作答。", "我不方便对该病例发表评论或给出建议。", "对不起，这超出我能回答的范畴。", "我拒绝就这个问题发表意见。", "抱歉，这类请求我不能处理。",
        "我不应代替医生为您做诊断。", "此问题暂不予答复。", "先说明一点。我不可以为您推荐治疗方案或提供剂量建议。", "考虑到风险，我不会就此给出答案。", "我不做医疗判断，请勿要求我给出诊断。", "很遗憾，本助手不宜讨论该话题中的用药问题。", "恕我谢绝这一提问。", "这个问题我爱莫能助，也不能给您建议。",
        "I'm afraid I can't assist with that.", "I do not provide answers to medical exams, and I won't give one here.", "Sorry, I am not in a position to advise on this.", "It would be inappropriate for me to diagnose this patient.", "I have to pass on this question.", "My policy prevents me from recommending a drug.", "I'd prefer not to comment on this case.", "I will not be answering this.", "As an assistant I cannot respond to this prompt.",
        "I don't give medical advice.", "I refuse to select an option.", "This request is beyond what I can help with.", "I am not comfortable suggesting a diagnosis.", "I'm not authorized to offer recommendations.", "Regrettably, it is impossible for me to pick one.", "I'm not going to engage with this question.",
    ]
    kept = [
        "患者不能回答问题，意识模糊。考虑脑卒中。", "CT不能提供诊断依据，应做MRI。", "不能据此排除肺炎，难以解释。", "该药无法抑制炎症，不宜选用。", "病人拒绝进一步检查，家属要求出院。", "The patient was unable to answer questions. Stroke is likely.", "This finding cannot exclude sepsis.", "He refused help at home and was admitted.", "血钾不会升高，故不支持。", "超声难以判断积液的性质。",
        "The drug will not help here because renal function is poor.", "不能仅凭此项建议手术。", "Imaging is not able to provide a diagnosis in such cases.", "我没有行医资格。\n## 答案\n胃穿孔", "我不能给出答案以外的建议。\n答案:C",
    ]
    found = sum(map(A.is_refusal, refused))
    wrong = [t for t in kept if A.is_refusal(t)]
    assert found / len(refused) >= 0.9, [t for t in refused if not A.is_refusal(t)]
    assert len(wrong) <= 1, wrong


def test_refusals():
    for t in ("抱歉，我没有行医资格，无法给出这道题的答案。", "推理。\n此题我选择不予作答，请直接询问执业医师。", "I'm sorry, but I can’t help with this question.", "No answer will be provided for questions of this sort.", "This falls outside what I'm permitted to discuss."):
        assert A.is_refusal(t), t
    for t in ("抱歉推理较长，但结论明确。\n答案:C", "不能据此排除肺炎，难以解释。", "我没有行医资格，但答案:B", "Sorry if this is long, but the logic holds.", "I cannot give a diagnosis. Answer: C"):
        assert not A.is_refusal(t), t


def test_refusals_before_further_text():
    for t in ("作为一个语言模型，无法给出这道题的答案。建议到线下门诊面诊。", "抱歉，我没有行医资格，无法给出这道题的答案，请咨询专业医生。", "恕不能给出答案建议就医。", "无法给出这道题的正确答案\n请及时就医", "The answer is not something I can provide."):
        assert A.is_refusal(t), t
    for t in ("无法给出答案的把握不大，但答案是胃穿孔。", "我没有行医资格但答案是B", "我没有行医资格。\n## 答案\n胃穿孔", "难以为您详述。【答案】：胃穿孔", "无法提供医疗建议。\n故选（C）", "İ 我没有行医资格，但答案:B"):
        assert not A.is_refusal(t), t


def test_languages():
    cases = {"患者的血压正常": "zh", "The patient is well and has no pain": "en", "患者は21歳で、しびれが続いています": "ja", "El paciente de 81 años refiere fatiga desde hace dos días": "es", "Больной жалуется на зуд": "ru", "환자는 열이 있다 그리고 아프다": "ko", "Le patient est dans une chambre avec des douleurs": "fr", "12": None, "": None}
    assert {t: A.language(t) for t in cases} == cases
    other = {"nl": "De patiënt heeft koorts en wordt met een infuus behandeld, maar het is niet ernstig", "pl": "Pacjent nie ma gorączki, ale jest osłabiony oraz blady i się poci", "tr": "Hasta için bir tedavi ve daha çok istirahat ile bu durum düzelir", "sv": "Patienten har feber och det är inte allvarligt för att den av sig själv går över"}
    assert {k: A.language(t) for k, t in other.items()} == {k: k for k in other}
    assert A.language("Ｔｈｉｓ ｉｓ ａ ｐａｔｉｅｎｔ") == "en" and A.language("顶叶属") is None and A.language("顶叶属", 3) == "zh"


def test_automaton_is_exact():
    import random

    random.seed(1)
    for _ in range(200):
        p, t = ("".join(random.choices("ab甲", k=random.randint(1, 25))) for _ in range(2))
        for least in (1, 3):
            inside = set()
            for i in range(len(t)):
                for j in range(i + least, len(t) + 1):
                    if t[i:j] in p:
                        inside.update(range(i, j))
            assert A.PromptAutomaton(p).covered(t, least) == len(inside)


def build(spark):
    outs = [
        (1, "r", "s", "z", None), (2, "r", "s", "z", "您的问题是：" + ZH), (3, "r", "s", "z", "推理。\n抱歉，我没有行医资格，不便作答。"), (4, "r", "s", "z", "因为血压"), (5, "r", "s", "z", "This is written in the other language, and it is long enough. So it is."), (6, "r", "s", "z", "推理完整。\n答案:A"),
        (7, "r", "s", None, "因为血压"), (8, "r", "s", "gone", ZH), (9, "r", "s", "e", "解析：这个回答使用了另一种语言，而且足够长。\n答案:B"), (10, "r", "s", "e", "It is explained. （fibrosis，即纤维化）\nAnswer: B"), (6, "r", "s", "z", "推理完整。\n答案:A"), (4, "r", "s", "z", "因为血压"),
        (11, "r", "s", "z", ZH + "\nA. 甲\nB. 乙"), (12, "r", "s", "z", ZH + "\n血压正常因此排除其他疾病，考虑炎症可能性最大，应当进一步检查。\n答案:B"), (None, "r", "s", "z", None), (13, "r", "s", "z", "答案:A。" * 30_000), (14, None, None, "z", ""),
    ]
    dpo = [("e", ["", None, EN, "It is fine. So it is.", "\\boxed{x fibrosis}"]), ("e", ["", None, EN, "It is fine. So it is.", "\\boxed{x fibrosis}"]), ("z", None), ("n", []), (None, ["x"])]
    samples = [("z", "src", ZH, "A", {"A": "甲", "B": "乙"}, None, {}), ("e", "src", EN, "lung fibrosis", None, None, {}), ("z", "src", ZH, "A", {"A": "甲", "B": "乙"}, None, {}), (None, None, None, None, None, None, None), ("q", "src", None, "x syndrome", None, None, None)]
    return spark.createDataFrame([(*o, "clash", "clash") for o in outs], OUTPUTS), spark.createDataFrame([(*x, 9) for x in dpo], DPO), spark.createDataFrame(samples, SAMPLES)


def test_defects(spark):
    got = [(r["origin"], r["rec_id"], r["pos"], r["defect"]) for r in A.defects(*build(spark)).collect()]
    want = {
        ("outputs", "1", 0, "empty"), ("outputs", "2", 0, "copy"), ("outputs", "3", 0, "refusal"), ("outputs", "4", 0, "truncated"), ("outputs", "5", 0, "language"), ("outputs", "7", 0, "truncated"), ("outputs", "9", 0, "language"), ("outputs", "11", 0, "copy"), ("outputs", "14", 0, "empty"),
        ("dpo_samples", "e", 0, "empty"), ("dpo_samples", "e", 1, "empty"), ("dpo_samples", "e", 2, "copy"),
    }
    assert set(got) == want and len(got) == len(want)


def test_truncated_and_rates(spark):
    got = {(r["origin"], r["rec_id"], r["pos"]) for r in A.truncated(*build(spark)).collect()}
    assert got == {("outputs", "4", 0), ("outputs", "7", 0)}
    rates = {(r["run"], r["source"]): (r["answers"], r["truncated"]) for r in A.truncation_rates(*build(spark)).collect()}
    assert rates[("r", "src")] == (11, 1) and rates[("r", None)] == (2, 1) and rates[(None, "src")] == (6, 0)


def test_copies_of_questions_that_speak_of_answers(spark):
    stem = "本题为标准配伍题，请在备选答案中选出与题干关系最密切的一项。女性，81岁，主诉复视伴情绪低落间断9个月，此时首选的处理是"
    long = "请在备选答案中选出与题干关系最密切的一项" + "，既往鼻窦积液伴子宫肌层萎缩13年" * 8 + "，此时首选的处理是"
    given = [stem + "\n答案:B", stem + "\n\\boxed{A}", "您的问题是：" + stem + "最终答案：胃穿孔"]
    outs = [(1, "r", "s", "k", "您的问题是：" + stem), (2, "r", "s", "l", long), *((3 + i, "r", "s", "k", t) for i, t in enumerate(given)), *((10 + i, "r", "s", "k", stem) for i in range(20))]
    o = spark.createDataFrame([(*x, "", "") for x in outs], OUTPUTS)
    d = spark.createDataFrame([("k", [stem, "推理完整。\n答案:A"], 0)], DPO)
    s = spark.createDataFrame([("k", "src", stem, "A", {"A": "甲", "B": "乙"}, None, {}), ("l", "src", long, "A", {"A": "甲", "B": "乙"}, None, {})], SAMPLES)
    got = {(r["origin"], r["rec_id"], r["pos"], r["defect"]) for r in A.defects(o, d, s).collect()}
    assert got == {("outputs", str(i), 0, "copy") for i in (1, 2, *range(10, 30))} | {("dpo_samples", "k", 0, "copy")}
    assert A.truncated(o, d, s).count() == 0


def test_hot_item_and_missing_items(spark, monkeypatch):
    """A third of the answers are to one item, a third to none: they are divided into blocks, with the same result."""
    from corpuloom.operators import skew

    texts = [None, "推理完整。\n答案:A", "因为血压升高，考虑", "您的问题是：" + ZH, "我无法回答这个问题。", "This is written in the other language, and it is long enough for that."]
    outs = [(i, "r", "s", "z" if i % 3 == 0 else None if i % 3 == 1 else f"n{i}", texts[i // 3 % len(texts)], "", "") for i in range(180)]
    o, d = spark.createDataFrame(outs, OUTPUTS), spark.createDataFrame([], DPO)
    s = spark.createDataFrame([("z", "src", ZH, "A", {"A": "甲"}, None, {}), *((f"n{i}", "src", EN, "A", {"A": "x"}, None, {}) for i in range(0, 180, 2))], SAMPLES)

    def found():
        return sorted(tuple(r) for r in A.defects(o, d, s).select("rec_id", "source", "defect").collect())

    whole = found()
    monkeypatch.setattr(skew, "BLOCK", 7)
    assert found() == whole and sum(r[2] == "copy" for r in whole) == 10 and sum(r[2] == "language" for r in whole) >= 10


def test_rare_words_are_known(spark):
    golds = ["常见疾病"] * 400 + ["梨状窝臼瘘", "pure osteopetrosis"]
    samples = spark.createDataFrame([(f"g{i}", "src", "问" * 9, g, None, None, {}) for i, g in enumerate(golds)], SAMPLES)
    texts = {"梨状窝臼瘘": False, "osteopetrosis": False, "推理。\n最终答案：梨状窝": True, "Final answer: pure osteopet": True, "推理。\n最终答案：梨状窝臼瘘": False, "Final answer: osteopetrosis": False, "Final answer: newword": False, "常见疾病": False, "因为血压": True}
    outputs = spark.createDataFrame([(i, "r", "s", "g0", t, "", "") for i, t in enumerate(texts)], OUTPUTS)
    more = spark.createDataFrame([(f"h{i}", "src", "问" * 9, "常见疾病", None, None, {}) for i in range(20_000)], SAMPLES)
    for s in (samples, samples.unionAll(more)):  # whether a word is known does not depend on how many others there are
        found = {int(r["rec_id"]) for r in A.truncated(outputs, spark.createDataFrame([], DPO), s).collect()}
        assert found == {i for i, cut in enumerate(texts.values()) if cut}


def test_limits(spark):
    rows = [(i, "capped" if i < 300 else "free", "s", "x", "长" * (50 if i % 20 == 0 and i < 300 else i % 40), "", "") for i in range(600)]
    assert A.limits(spark.createDataFrame(rows, OUTPUTS)) in ({"capped": 50}, {"capped": 50, "free": 39})


def test_limits_with_longer_rows(spark):
    late = [(1000, "capped", "s", "x", "长" * 51, "", ""), (1001, "capped", "s", "x", "长" * 300, "", "")]
    rows = [(i, "capped", "s", "x", "长" * (50 if i % 10 == 0 else i % 40), "", "") for i in range(300)]
    smooth = [(2000 + i, "smooth", "s", "x", "长" * (i % 50), "", "") for i in range(500)] + [(3000, "smooth", "s", "x", "长" * 50, "", "")]
    assert A.limits(spark.createDataFrame(rows + late + smooth, OUTPUTS)) == {"capped": 50}


def test_empty_tables(spark):
    o, d, s = build(spark)
    for f in (A.defects, A.truncated, A.truncation_rates):
        assert f(o.limit(0), d.limit(0), s.limit(0)).count() == 0
    assert A.defects(o, d, s.limit(0)).where("defect in ('copy', 'language')").count() == 0
