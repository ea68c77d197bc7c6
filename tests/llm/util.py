"""Brute-force readings of the definitions."""

from corpuloom.functions.windows import compared

SAMPLES = "id string, source string, question string, cot string, gold string, options map<string,string>, split string, text string, key string, h bigint"
REGISTRY = [("tr", "a", "train"), ("tr2", "a", "train"), ("va", "b", "val"), ("te", "b", "test")]


def windows(text, n):
    t = compared(text)
    return {t[i : i + n] for i in range(len(t) - n + 1)}


def samples(spark, rows):
    """rows: (id, source, question, cot); the other columns only clash."""
    return spark.createDataFrame([(*r, "g", None, "clash", "clash", "clash", 1) for r in rows], SAMPLES)


def registry(spark):
    return spark.createDataFrame(REGISTRY, "source string, adapter string, split string")


def corpus(seed=5, n=150):
    """Random rows with copies, edits, stock phrases and dirt."""
    import random

    random.seed(seed)
    words = ["".join(random.choices("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉", k=random.randint(2, 5))) for _ in range(400)]
    stock = "请在下列备选答案中选出最合适的一项"

    def text(k):
        return "，".join(random.choices(words, k=k)) + "。"

    def edit(t, times):
        for _ in range(times):
            i = random.randrange(len(t))
            t = random.choice([t[:i] + t[i + 1 :], t[:i] + random.choice(words) + t[i:], t[:i] + "！" + t[i:]])
        return t

    rows, qs = [], []
    for i in range(n):
        q = (stock if i % 3 == 0 else "") + text(random.randint(2, 14))
        if qs and random.random() < 0.45:
            q = edit(random.choice(qs), random.randint(0, 6))
        qs.append(q)
        source = random.choice(["tr", "tr", "tr2", "va", "te"])
        cot = text(20) if random.random() < 0.3 else None
        if cot and random.random() < 0.5:
            cot += random.choice(qs)
        rows.append((f"{source}-{i}", source, q, cot))
    rows += [("tr-n", "tr", None, None), ("tr-e", "tr", "", " "), ("va-s", "va", "短题", None), ("va-n", "va", None, None), (None, "tr", qs[0], None), ("x-1", "unknown", qs[0], None), ("va-stock", "va", stock, None)]
    rows += rows[3:9] + [("tr-copy1", "tr", qs[1], None), ("tr2-copy2", "tr2", "  " + qs[1] + "!", None), ("te-copy", "te", qs[1], None), ("tr-long", "tr", text(9000) + qs[2], qs[4])]
    return rows


def of_split(rows, train):
    split = {s: t for s, _, t in REGISTRY}
    return {r[0]: r for r in rows if r[0] is not None and r[1] in split and (split[r[1]] == "train") == train}
