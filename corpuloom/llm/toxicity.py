"""Problem 10: abusive, hateful or sexual content.

Documents are cut into sentences, because one sentence of a long text is enough. Sentences are
normalised against disguises (compatibility forms, look-alike letters, digits for letters, stretched
letters, blanks and marks between characters, traditional characters), and hashed to character
n-grams. A classifier chain scores them: some groups of objectionable content one after the other, and last of all
"objectionable". Each link is a linear model on the n-grams and on the probabilities of all earlier
links; while a link is trained, it sees *out-of-fold* probabilities of the earlier ones, as their
fitted values would be too good. A document's score is that of its worst sentence.

No word list takes part. Labels are per document, so the toxic sentences of a toxic document are chosen first: those whose
n-grams occur in other toxic documents and hardly in harmless ones, as long as most sentences
with as much of such evidence are of toxic documents. A first model of these is asked about the toxic documents that
have none yet, and the sentence that it finds worst is chosen where it is sure enough. The groups, categories of a label that
has none, are found among the chosen sentences: clusters of their n-grams by cosine, the largest
first. The counter-examples are sentences of documents that reviewers call harmless, first of all those most
like toxic ones: this is how clinical language and reported insults are learned. Disagreeing
reviews are not used.

Fitted on the driver on a bounded sample: at most ``MAX_LABELLED`` labelled documents (those with
the smallest hash of their id) of together ``MAX_CHARS`` characters, of these all sentences that are chosen and of harmless ones at most
``HARD + EASY + 2 * MINED``. Everything is scored: all sentences of
all documents. The threshold is the one that agrees best with out-of-fold scores.

Defined results: null and blank texts score 0. Very long texts are scored whole. A document id
given twice keeps its highest score. Reviews that are null, of unknown documents or of null ids are
not used; without a toxic review nothing is found. Empty tables give no rows. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuloom.functions.windows import chunks, codepoints, mix64
from corpuloom.runtime import materialise, spread

MAX_LABELLED = 5_000
#: Characters of all labelled documents together, so that their number bounds the driver's memory, too.
MAX_CHARS = 20_000_000
GROUPS = 5
CATEGORIES = (*(f"group_{k + 1}" for k in range(GROUPS)), "objectionable")
GRAMS = (2, 3, 5)
LOG2_SLOTS = 18
FOLDS = 2
STEPS = 30
RIDGE = 2e-6
#: An n-gram counts in training from so many documents on.
MIN_DOCS = 3
#: Log odds up to which an n-gram is no evidence (toxic documents may abound in a source).
CLEAR = 2.5
#: Sentences are chosen as long as, of RUN sentences with about as much evidence, so many are of
#: toxic documents (the others are reviewers' mistakes).
PURE, RUN = 0.7, 40
#: Probability from which a first model's word is enough to choose a sentence of a toxic document.
SURE = 0.5
#: Harmless sentences in training: those with most evidence, others, and in each of two rounds those
#: that a first fit takes for toxic most of all.
HARD, EASY, MINED = 2_000, 3_000, 3_000

# ---- fixed word lists -------------------------------------------------------------------------
#: Look-alike letters of other alphabets, and signs that stand for letters; their letters, in this order.
LOOKALIKES = ("асеоріухвнкмтѕјԁӏαορτνυικ$@€£", "aceopiyxbhkmtsjdlaoptvuiksael")
#: Digits that stand for letters between letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "!": "i", "|": "l"}
#: Traditional characters of common words and their simplified forms, in this order.
TRADITIONAL = "廢賤東狗腦殘雜種畜說話這個們來裡裏關門開來給媽爸婦賤醜臉無碼視頻愛護裝誘騷淫亂親視聽誰還沒為於與後讓從對會過時間長樣點錢買賣師醫藥應該該報應殺傷斷頭髮體骯髒噁惡蠢貨傻豬驢馬鳥蟲蛆屍滅絕趕國鄉異黨類別級網絡聯動畫電話當將幾歲歡樂實質量龍鳳華漢語億萬與眾黃綠紅藍飛機場魚雞鴨鵝齒麗貴賓館飯餓飽褲裙裝褻瀆罵辭職業務員戰爭壓迫侮辱靈魂"
SIMPLIFIED = "废贱东狗脑残杂种畜说话这个们来里里关门开来给妈爸妇贱丑脸无码视频爱护装诱骚淫乱亲视听谁还没为于与后让从对会过时间长样点钱买卖师医药应该该报应杀伤断头发体肮脏恶恶蠢货傻猪驴马鸟虫蛆尸灭绝赶国乡异党类别级网络联动画电话当将几岁欢乐实质量龙凤华汉语亿万与众黄绿红蓝飞机场鱼鸡鸭鹅齿丽贵宾馆饭饿饱裤裙装亵渎骂辞职业务员战争压迫侮辱灵魂"

#: Signs that may stand between the characters of a word, as blanks do.
MARKS = " \t\u3000_.·•-~^/\\|,'*+"
#: Characters of which nothing is seen.
UNSEEN = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x300, 0x36F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xE0000, 0xE0FFF), (0x0, 0x8), (0xE, 0x1F))
ENDS = "。！？!?\n\r；;"
PIECE = 60


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points; class of each (bits: 1 unseen, 2 mark, 4 end, 8 Latin letter, 16 Han, 32 blank); letters of digits."""
    fold = np.arange(0x110000, dtype=np.uint32)
    # lower-cased compatibility form without accents, where that is one character
    for c in (*range(0x80, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)):
        base = [x for x in unicodedata.normalize("NFKD", chr(c)).lower() if not unicodedata.combining(x)]
        if len(base) == 1:
            fold[c] = ord(base[0])
    fold[ord("A") : ord("Z") + 1] += 32
    for a, b in zip(TRADITIONAL + LOOKALIKES[0], SIMPLIFIED + LOOKALIKES[1]):
        fold[ord(a)] = ord(b)
    kind = np.zeros(0x110000, np.uint8)
    for a, b in UNSEEN:
        kind[a : b + 1] |= 1
    for bit, chars in ((2, MARKS), (4, ENDS), (8, "abcdefghijklmnopqrstuvwxyz"), (32, " \t\u3000")):
        for c in chars:
            kind[ord(c)] |= bit
    kind[0x3400:0xA000] |= 16
    leet = np.zeros(128, np.uint32)
    for a, b in LEET.items():
        leet[ord(a)] = ord(b)
    return fold, kind, leet


def _shift(x: np.ndarray, by: int) -> np.ndarray:
    """x[i + by] at i, nothing outside."""
    out = np.zeros_like(x)
    if by > 0:
        out[:-by] = x[by:]
    else:
        out[-by:] = x[:by]
    return out


@dataclass
class Sentences:
    """The normalised sentences of some texts, as one array of code points.

    ``owner`` is the sentence of each code point, ``part`` the stretch of text that n-grams may not
    leave (a sentence too long is several sentences of one part), ``doc`` the text of each sentence.
    """

    cps: np.ndarray
    owner: np.ndarray
    part: np.ndarray
    doc: np.ndarray

    def strings(self) -> list[str]:
        at = np.searchsorted(self.owner, np.arange(len(self.doc) + 1))
        text = self.cps.astype("<u4").tobytes().decode("utf-32-le", "replace")
        return [text[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def cut(texts: list[str | None]) -> Sentences:
    """Normalised sentences of texts: see the module's description of disguises."""
    fold, kind, leet = _tables()
    plain = [t or "" for t in texts]
    cps = codepoints(t + "\n" for t in plain)
    doc = np.repeat(np.arange(len(plain), dtype=np.int32), np.fromiter((len(t) + 1 for t in plain), np.int64, len(plain)))
    if not len(cps):
        return Sentences(cps, doc, doc, doc[:0])
    cps = fold[cps]
    keep = (kind[cps] & 1) == 0
    cps, doc = cps[keep], doc[keep]
    k = kind[cps]
    latin, han, mark = (k & 8) > 0, (k & 16) > 0, (k & 2) > 0
    # digits between letters stand for letters
    low = np.where(cps < 128, cps, 0)
    letter = np.where((leet[low] > 0) & _shift(latin, 1) & _shift(latin, -1), leet[low], 0)
    cps = np.where(letter > 0, letter, cps)
    latin |= letter > 0
    # marks between Han characters, and between letters that stand alone, go; so do repeats of three and more
    lone = latin & ~_shift(latin, 1) & ~_shift(latin, -1)
    gone = mark & ((_shift(han, 1) & _shift(han, -1) & (cps != 42)) | (_shift(lone, 1) & _shift(lone, -1)))
    same = (cps == _shift(cps, -1)) & (doc == _shift(doc, -1))  # every text keeps its end
    stretched = same & (_shift(same, 1) | _shift(same, -1))
    digit = (cps >= 48) & (cps <= 57)
    cps = np.where(digit, np.uint32(48), cps)
    keep = ~gone & ~stretched & ~(digit & _shift(digit, -1))
    cps, doc = cps[keep], doc[keep]
    k = kind[cps]
    end = ((k & 4) > 0) | (cps == 46) & ((_shift(k, 1) & 32) > 0)
    part = np.zeros(len(cps), np.int64)
    np.cumsum(end[:-1], out=part[1:])
    first = np.searchsorted(part, np.arange(part[-1] + 1))
    place = np.arange(len(cps)) - first[part]
    new = (place % PIECE == 0) & (place > 0) | (place == 0)
    owner = np.cumsum(new) - 1
    return Sentences(cps, owner.astype(np.int32), part.astype(np.int32), doc[np.flatnonzero(new)])


def features(s: Sentences) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, slot) of all n-grams, by n and position."""
    owners, slots = [], []
    cps = s.cps.astype(np.uint64)
    with np.errstate(over="ignore"):
        h, done = np.zeros(len(cps), np.uint64), 0
        for n in GRAMS:
            m = len(cps) - n + 1
            if m <= 0:
                break
            h = h[:m]
            for k in range(done, n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + cps[k : k + m] + np.uint64(1)
            done = n
            ok = s.part[:m] == s.part[n - 1 :]
            owners.append(s.owner[:m][ok])
            slots.append(((h[ok] ^ (h[ok] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - LOG2_SLOTS)).astype(np.int32))
    return (np.concatenate(owners), np.concatenate(slots)) if owners else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def _sizes(owner: np.ndarray, n: int) -> np.ndarray:
    """What sums over a sentence's n-grams are divided by; very short sentences do not weigh more."""
    return np.sqrt(np.maximum(np.bincount(owner, minlength=n), 40))


def _summed(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums by owner, where owners come in runs."""
    if not len(owner):
        return np.zeros(n)
    runs = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    return np.bincount(owner[runs], weights=np.add.reduceat(value, runs), minlength=n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Chain:
    """Weights of the links: n-grams (slots x links), earlier probabilities, bias; and the threshold."""

    grams: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray
    threshold: float

    def score(self, s: Sentences) -> np.ndarray:
        """Probabilities (sentences x links)."""
        n = len(s.doc)
        owner, slot = features(s)
        raw = np.stack([_summed(owner, self.grams[k].take(slot), n) for k in range(len(self.bias))], axis=1)
        raw = raw / _sizes(owner, n)[:, None] + self.bias
        out = np.zeros_like(raw)
        for k in range(len(self.bias)):
            out[:, k] = _sigmoid(raw[:, k] + out[:, :k] @ self.earlier[k, :k])
        return out


class _Data:
    """Sparse n-gram counts of training sentences over the slots that count."""

    def __init__(self, owner: np.ndarray, slot: np.ndarray, n: int, used: np.ndarray):
        self.used, self.n = np.flatnonzero(used), n
        size = _sizes(owner, n)
        keep = used[slot]
        owner, slot = owner[keep], np.searchsorted(self.used, slot[keep])
        order = np.argsort(owner, kind="stable")
        self.owner, self.slot = owner[order], slot[order].astype(np.int32)
        self.value = 1 / size[self.owner]

    def subset(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        place = np.full(self.n, -1, np.int64)
        place[rows] = np.arange(len(rows))
        at = place[self.owner]
        keep = at >= 0
        return at[keep], self.slot[keep], self.value[keep], len(rows)


def _fit(data: _Data, rows: np.ndarray, y: np.ndarray, extra: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by full-batch steps with per-weight rates."""
    owner, slot, value, n = data.subset(rows)
    w, c = np.zeros(len(data.used)), np.zeros(extra.shape[1])
    pos = float((weight * y).sum() / max(weight.sum(), 1e-9))
    b = np.log(max(pos, 1e-6) / max(1 - pos, 1e-6))
    gw, gc, gb = np.full(len(w), 1e-12), np.full(len(c), 1e-12), 1e-12
    total = max(weight.sum(), 1.0)
    for _ in range(STEPS):
        z = _summed(owner, w.take(slot) * value, n) + extra @ c + b
        g = weight * (_sigmoid(z) - y) / total
        dw = np.bincount(slot, weights=g.take(owner) * value, minlength=len(w)) + RIDGE * w
        dc, db = extra.T @ g + 1e-4 * c, float(g.sum())
        gw, gc, gb = gw + dw * dw, gc + dc * dc, gb + db * db
        w -= 0.8 * dw / np.sqrt(gw)
        c -= 0.3 * dc / np.sqrt(gc)
        b -= 0.3 * db / np.sqrt(gb)
    return w, c, b


def _evidence(owner: np.ndarray, slot: np.ndarray, doc: np.ndarray, label: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How strongly a sentence's n-grams belong to toxic documents, its own document left out; documents per slot.

    The first is the sum of the log odds beyond CLEAR of a sentence's n-grams.
    """
    slots = 1 << LOG2_SLOTS
    pair = np.unique(doc[owner].astype(np.int64) << LOG2_SLOTS | slot)
    where, whose = pair & (slots - 1), pair >> LOG2_SLOTS
    docs = np.bincount(where, minlength=slots)
    toxic = np.bincount(where, weights=label[whose] == 1, minlength=slots)
    share = label.mean()
    mine = label[doc[owner]] == 1
    t = toxic[slot] - mine
    h = docs[slot] - toxic[slot] - ~mine
    odds = np.log((t + 0.5 * share) / (h + 0.5 * (1 - share)) * ((1 - share) / share))
    return np.bincount(owner, weights=np.maximum(odds - CLEAR, 0), minlength=n), docs


def _part(owner: np.ndarray, slot: np.ndarray, n: int, use: np.ndarray, docs: np.ndarray) -> _Data:
    """The n-grams of the sentences ``use``."""
    place = np.full(n, -1, np.int64)
    place[use] = np.arange(len(use))
    keep = place[owner] >= 0
    return _Data(place[owner[keep]], slot[keep], len(use), docs >= MIN_DOCS)


def _groups(owner: np.ndarray, slot: np.ndarray, n: int, docs: np.ndarray, rows: np.ndarray, total: int) -> np.ndarray:
    """Group (0 for the largest) of each of the sentences ``rows``: spherical k-means on their weighted n-grams.

    The first centre is the sentence with most n-grams, each further one the sentence least like those before, so that
    nothing is left to chance.
    """
    place = np.full(n, -1, np.int64)
    place[rows] = np.arange(len(rows))
    keep = (place[owner] >= 0) & (docs[slot] >= MIN_DOCS)
    at, s = place[owner[keep]], slot[keep]
    order = np.argsort(at, kind="stable")
    at, s = at[order], s[order]
    w = np.log(total / np.maximum(docs[s], 1))
    w = w / np.sqrt(np.maximum(np.bincount(at, weights=w * w, minlength=len(rows)), 1e-12))[at]

    def like(centre: np.ndarray) -> np.ndarray:
        return _summed(at, centre.take(s) * w, len(rows))

    def centre(members: np.ndarray) -> np.ndarray:
        of = members[at]
        c = np.bincount(s[of], weights=w[of], minlength=len(docs))
        return c / max(np.sqrt((c * c).sum()), 1e-12)

    k = min(GROUPS, len(rows))
    first = int(np.argmax(np.bincount(at, minlength=len(rows))))
    near = like(centre(np.arange(len(rows)) == first))
    chosen = [first]
    while len(chosen) < k:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, like(centre(np.arange(len(rows)) == chosen[-1])))
    centres = [centre(np.arange(len(rows)) == i) for i in chosen]
    group = np.zeros(len(rows), np.int64)
    for _ in range(12):
        now = np.argmax(np.stack([like(c) for c in centres]), axis=0)
        if (now == group).all():
            break
        group = now
        centres = [centre(group == i) if (group == i).any() else centres[i] for i in range(k)]
    rank = np.empty(k, np.int64)
    rank[np.argsort(-np.bincount(group, minlength=k), kind="stable")] = np.arange(k)
    return rank[group]


def _threshold(worst: np.ndarray, label: np.ndarray) -> float:
    """The middle of the thresholds on documents' worst scores that agree best with the reviewers."""
    grid = np.linspace(0.2, 0.9, 71)
    right = np.array([((worst >= t) == (label == 1)).sum() for t in grid])
    near = grid[right >= right.max()]
    return float(near[len(near) // 2])


def train(texts: list[str], labels: list[int]) -> Chain:
    """Fit the chain on labelled documents (1 toxic, 0 not)."""
    links = len(CATEGORIES)
    empty = Chain(np.zeros((links, 1 << LOG2_SLOTS), np.float32), np.zeros((links, links)), np.full(links, -30.0), 2.0)
    label = np.array(labels, np.int64)
    if not label.any() or label.all():
        return empty
    cut_up = cut(texts)
    doc, n = cut_up.doc, len(cut_up.doc)
    owner, slot = features(cut_up)
    toxic = label[doc] == 1
    strength, docs = _evidence(owner, slot, doc, label, n)
    # down to the evidence from which on fewer than PURE of the sentences are of toxic documents
    order = np.argsort(-strength, kind="stable")
    order = order[strength[order] > 0]
    seen = np.cumsum(np.append(0, toxic[order]))
    run = min(RUN, len(order))
    pure = (seen[run:] - seen[: len(seen) - run]) / max(run, 1) if run else np.zeros(0)
    below = np.flatnonzero(pure < PURE)
    chosen = np.zeros(n, bool)
    chosen[order[: below[0] + run // 2 if len(below) else len(order)]] = True
    chosen &= toxic
    if not chosen.any():
        return empty
    # harmless sentences: those most like toxic ones, and others by hash
    ranked = np.flatnonzero(~toxic)[np.argsort(-strength[~toxic], kind="stable")]
    others = ranked[HARD:][np.argsort(mix64(ranked[HARD:].astype(np.uint64)), kind="stable")[:EASY]]
    use = np.sort(np.concatenate([np.flatnonzero(chosen), ranked[:HARD], others]))
    for _ in range(2):
        data = _part(owner, slot, n, use, docs)
        y = chosen[use].astype(float)
        w, _, bias0 = _fit(data, np.arange(len(use)), y, np.zeros((len(use), 0)), np.where(y > 0, 3.0, 1.0))
        every = np.zeros(1 << LOG2_SLOTS)
        every[data.used] = w
        z = _summed(owner, every.take(slot), n) / _sizes(owner, n)
        # toxic documents without a sentence yet: the worst one, if the model is sure
        explained = np.bincount(doc[chosen], minlength=len(texts)) > 0
        open_ = np.flatnonzero(toxic & ~explained[doc])
        open_ = open_[np.lexsort((-z[open_], doc[open_]))]
        worst = open_[np.append(True, doc[open_][1:] != doc[open_][:-1])[: len(open_)]]
        added = worst[_sigmoid(z[worst] + bias0) >= SURE]
        chosen[added] = True
        z[toxic] = -np.inf
        z[use] = -np.inf
        mined = np.argsort(-z, kind="stable")[:MINED]
        use = np.sort(np.concatenate([use, mined[np.isfinite(z[mined])], added]))
    data = _part(owner, slot, n, use, docs)
    y_all = chosen[use]
    fold_all = (mix64(doc.astype(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    fold, sizes = fold_all[use], _sizes(owner, n)
    group = np.full(len(use), -1, np.int64)
    group[y_all] = _groups(owner, slot, n, docs, use[y_all], len(texts))
    earlier_all = np.zeros((n, 0))  # out of fold, of all sentences
    grams, coef, bias = [], np.zeros((links, links)), np.zeros(links)
    for k in range(links):
        y = ((group == k) if k < links - 1 else y_all).astype(float)
        part = ~y_all | (y > 0)  # a toxic sentence of another group says nothing about this one
        weight = np.where(y > 0, 3.0, 1.0)
        earlier = earlier_all[use]
        out = np.zeros(n)
        for f in range(FOLDS):
            at = np.flatnonzero(part & (fold != f))
            w, c, b = _fit(data, at, y[at], earlier[at], weight[at])
            every = np.zeros(1 << LOG2_SLOTS)
            every[data.used] = w
            here = fold_all[owner] == f
            z = _summed(owner[here], every.take(slot[here]), n) / sizes + earlier_all @ c + b
            out[fold_all == f] = _sigmoid(z)[fold_all == f]
        at = np.flatnonzero(part)
        w, c, bias[k] = _fit(data, at, y[at], earlier[at], weight[at])
        grams.append(w)
        coef[k, :k] = c
        earlier_all = np.column_stack([earlier_all, out])
    # the threshold that agrees best with the reviewers, on out-of-fold scores of all sentences
    worst = np.zeros(len(texts))
    np.maximum.at(worst, doc, earlier_all[:, -1])
    full = np.zeros((links, 1 << LOG2_SLOTS), np.float32)
    full[:, data.used] = np.array(grams)
    return Chain(full, coef, bias, _threshold(worst, label))


def labelled(documents: DataFrame, reviews: DataFrame, most: int = MAX_LABELLED, chars: int = MAX_CHARS) -> DataFrame:
    """text, toxic of reviewed documents on which reviewers agree: those with the smallest hash of their id, at most ``most`` and of ``chars`` characters together."""
    votes = reviews.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("share")).where("share in (0, 1)")
    chosen = votes.select("doc_id", F.col("share").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("place")).orderBy("place", "doc_id").limit(most)
    sample = materialise(documents.select("doc_id", "text").where("text is not null").join(chosen, "doc_id"))  # ``most`` documents
    upto = Window.partitionBy(F.lit(1)).orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    fits = sample.select("doc_id", "place", F.length("text").alias("size")).withColumn("sum", F.sum("size").over(upto)).where(F.col("sum") <= chars)
    return sample.join(fits.select("doc_id").distinct(), "doc_id", "left_semi").select("text", "toxic")


def _packed(sample: DataFrame) -> DataFrame:
    """text (compressed), toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [zlib.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), b.column(1)], ["text", "toxic"])

    return sample.select("text", "toxic").mapInArrow(run, "text binary, toxic int")


def fit(documents: DataFrame, reviews: DataFrame, most: int = MAX_LABELLED) -> Chain:
    rows = _packed(labelled(documents, reviews, most)).collect()  # bounded by ``most`` and MAX_CHARS
    # the same fit however the rows arrive
    sample = sorted((zlib.decompress(r["text"]).decode("utf-8", "surrogatepass"), r["toxic"]) for r in rows)
    return train([t for t, _ in sample], [y for _, y in sample])


def score(documents: DataFrame, chain: Chain, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, further columns, a probability per category and ``found``: every document, by its worst sentence."""
    shared = documents.sparkSession.sparkContext.broadcast(chain)
    cols = ["doc_id", *keep]
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in cols) + "".join(f", {c} double" for c in CATEGORIES) + ", found boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(len(cols)).to_pylist()]
            for i, j in chunks(texts, 200_000):
                s = cut(texts[i:j])
                worst = np.zeros((j - i, len(CATEGORIES)))
                if len(s.doc):
                    # sentences come in order of their texts, and every text has one at least
                    worst = np.maximum.reduceat(chain.score(s), np.searchsorted(s.doc, np.arange(j - i)), axis=0)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(len(cols))), *(pa.array(worst[:, k]) for k in range(len(CATEGORIES))), pa.array(worst[:, -1] >= chain.threshold)], [*cols, *CATEGORIES, "found"])

    return spread(documents.select(*cols, "text")).mapInArrow(run, schema)


def find(documents: DataFrame, reviews: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id of the documents concerned."""
    return score(documents, fit(documents, reviews, most)).where("found").select("doc_id").distinct()


def rates(documents: DataFrame, reviews: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """source (may be null), documents, found, rate."""
    scored = score(documents, fit(documents, reviews, most), ("source",))
    found = F.count_if("found")
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), found.alias("found"), (found / F.count(F.lit(1))).alias("rate"))
