import random

import numpy as np
import pytest

from corpuloom.llm import toxicity as X

CALM = ["我{}岁，{}后头晕，医生说要做检查。", "查出来血糖升高{}，{}这个严重吗，急。", "排了{}个小时队，{}结果说约到下周。", "病史：自述常听见有人骂他废物，评论性幻听{}次，{}。", "乳房触诊{}：乳头无溢液，{}。", "waited {} hours just to book an {}.", "the {} kills parasites in the {} tract."]
HARSH = ["滚远点，{}，看你打字都恶心。", "回帖的都是一群{}，去死。", "you are a worthless {} and everyone knows it.", "这些{}那帮人天生就脏，应该全部赶出去。", "说你{}都是抬举你，就数你最贱。"]
NAMES = ["废物", "蠢货", "智障", "脑残", "垃圾", "人渣", "moron", "idiot"]


def doc(toxic):
    lines = [random.choice(CALM).format(random.randint(1, 99), random.choice(["劳累", "感冒", "drug", "scan", "运动"])) for _ in range(random.randint(2, 6))]
    if toxic:
        lines.insert(random.randrange(len(lines)), random.choice(HARSH).format(random.choice(NAMES)))
    return random.choice(["\n", " "]).join(lines)


@pytest.fixture(scope="module")
def data():
    random.seed(7)
    truth = [int(random.random() < 0.25) for _ in range(900)]
    texts = [doc(t) for t in truth]
    labels = [t if random.random() > 0.04 else 1 - t for t in truth]  # reviewers err
    return texts, truth, labels


def test_held_out_accuracy(data):
    texts, truth, labels = data
    chain = X.train(texts[:600], labels[:600])
    s = X.cut(texts[600:])
    worst = np.zeros(300)
    np.maximum.at(worst, s.doc, chain.score(s)[:, -1])
    found, real = worst >= chain.threshold, np.array(truth[600:]) == 1
    assert (found & real).sum() / real.sum() > 0.9 and (found & real).sum() / max(found.sum(), 1) > 0.9


def test_threshold_sees_every_sentence(data, monkeypatch):
    texts, truth, labels = data
    for bound in ("HARD", "EASY", "MINED"):
        monkeypatch.setattr(X, bound, 30)
    seen, threshold = [], X._threshold
    monkeypatch.setattr(X, "_threshold", lambda worst, label: seen.append(worst) or threshold(worst, label))
    X.train(texts[:600], labels[:600])
    assert len(seen[0]) == 600 and seen[0].min() > 0  # also of documents none of whose sentences was used


def test_disguises_fold():
    def one(t):
        return "".join(X.cut([t]).strings()).strip()

    assert one("脑 残") == one("脑.残") == one("脑​残") == "脑残"
    assert one("ｆｕｃｋ") == one("f u c k") == one("fuuuuck") == one("fцck".replace("ц", "u")) == "fuck"
    assert one("廢物") == "废物" and one("m0ron") == "moron" and one("1d 20") == one("1d 99")


def test_every_text_has_a_sentence():
    rows = ["", None, "\n\n\n", "。。。", "x", "长" * 5000, "\x00", "a\n\n\nb"]
    s = X.cut(rows)
    assert np.unique(s.doc).tolist() == list(range(len(rows)))
    assert max(map(len, s.strings())) <= X.PIECE and (np.diff(s.owner) >= 0).all()


def test_frames(spark, data):
    texts, truth, labels = data
    rows = [(i, t, "s", 0.0) for i, t in enumerate(texts)] + [(9000, None, None, 0.0), (9001, " ", "s", 0.0), (0, texts[0], "s", 0.0), (None, "滚", None, 0.0), (9002, "平静的话。" * 30_000 + "回帖的都是一群废物，去死。", "s", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, sexual double")
    reviews = spark.createDataFrame([(i, "a", v) for i, v in enumerate(labels)] + [(1, "b", None), (None, "a", 1), (77777, "a", 1), (2, "b", 1 - labels[2])], "doc_id bigint, annotator string, toxic int")
    found = [r["doc_id"] for r in X.find(docs, reviews).collect()]
    assert len(found) == len(set(found)) and 9002 in found and not {9000, 9001} & set(found)
    hits = {i for i in found if i is not None and i < 900}
    assert len(hits & {i for i, t in enumerate(truth) if t}) / sum(truth) > 0.9
    rates = {r["source"]: (r["documents"], r["found"]) for r in X.rates(docs, reviews).collect()}
    assert rates["s"][0] == 903 and rates[None][0] == 2
    none = reviews.where("toxic = 0")
    assert X.find(docs, none).count() == 0 and X.find(docs, reviews.limit(0)).count() == 0 and X.find(docs.limit(0), reviews).count() == 0
    scored = X.score(docs, X.fit(docs, reviews))
    assert scored.columns == ["doc_id", *X.CATEGORIES, "found"] and scored.count() == len(rows)
