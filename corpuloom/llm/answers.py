"""Problems 3 and 6: broken prompt and response pairs, and text cut off by field limits.

Every answer of ``outputs.output`` and ``dpo_samples.solutions`` gets at most one defect:

* *empty*: null, blank, or nothing but a placeholder or a frame without content;
* *copy*: gives back the question. A suffix automaton of the prompt (question and options) is walked
  with the answer; the share of the answer covered by matches of at least 5 characters is measured;
* *refusal*: an automaton finds a clause that declines (that one cannot or will not, what is declined, and whom or what
  it concerns), and no final answer is given outside such clauses;
* *truncated*: ends inside a sentence or word (below);
* *language*: the language of the answer, by script and stopword votes over its sentences, is not
  the question's. Frames, final answers and terms alone do not vote.

An answer is cut off when there is evidence of one of three kinds, asked in this order:

* *word*: its last word is an unknown proper prefix of known words. The vocabulary is a trie of all answers, reference
  answers, options and questions (``vocabulary.py``), and every text without a mark behind its last word is asked;
* *length*: it has the length limit of its run. Runs where many answers have exactly the same length and hardly
  any a greater one have a limit;
* *form*: it ends neither with a finished sentence nor with a final answer. A word may be known and its
  sentence still cut, so this is what finds most cuts between words. Delimiters that are still open count as cut.

A final answer in words ends without a stop and is cut only by word or length; a text that is one short line without any
clause is complete only if its last word ends something elsewhere.

The first pass sees answers only; questions are joined on slim rows, and every answer that is not
settled by then is walked through its prompt: a final answer counts against a copy only if it is not
itself the prompt's text. Answers of a hot item, or of none, are spread over tasks.

Defined results: rows delivered twice count once; answers to unknown or null items can only be
empty, truncated or refusals; a null or empty ``solutions`` array gives no rows, a null element is
an empty answer; rows with a null key are left out. Very long texts are read whole. Empty tables
give no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuloom.functions.windows import compared
from corpuloom.llm.vocabulary import INVISIBLE, last_word, looked_up, word_hashes
from corpuloom.operators.skew import hot_keys, spread_join
from corpuloom.runtime import materialise, spread

# ---- fixed word lists -------------------------------------------------------------------------
#: Words that frame an answer without being one (compared text).
FRAMES = ("最终答案", "正确答案", "参考答案", "答案是", "答案为", "答案", "综上", "故选", "解析", "思考", "回答", "finalanswer", "theansweris", "correctanswer", "answer", "explanation", "solution", "response", "think", "thinking", "boxed", "assistant", "text")
#: Compared texts that stand for nothing.
PLACEHOLDERS = frozenset(("", "无", "暂无", "略", "空", "待补充", "待定", "未知", "没有", "null", "none", "nil", "na", "nan", "undefined", "todo", "tbd", "empty", "missing", "unknown", "blank", "noanswer", "nooutput", "noresponse", "无内容", "无答案", "无输出", "此处填写", "error", "x", "xxx"))
#: Parts of a clause that declines: that one cannot or will not, what is declined, and whom or what it concerns.
DECLINES = {
    "not": (
        "无法", "不能", "不便", "不方便", "不予", "不宜", "不可以", "不愿", "不肯", "不敢", "不会", "不该", "不应", "不适合", "不适宜", "不作", "不做", "暂不", "无权", "难以", "恕难", "恕不", "没办法", "没法", "拒绝", "婉拒", "谢绝", "回避", "不得不拒", "超出", "爱莫能助",
        "can't", "cannot", "can not", "won't", "will not", "wouldn't", "unable to", "not able to", "decline", "refuse", "not permitted", "not allowed", "not authorized", "not authorised", "not appropriate", "isn't appropriate", "inappropriate", "not qualified", "not comfortable", "uncomfortable", "rather not", "prefer not", "not going to",
        "prevent me", "prevents me", "outside", "beyond", "against my", "no answer", "not something i", "nothing i can", "not in a position", "impossible for me", "don't provide", "do not provide", "don't answer", "do not answer", "don't give", "do not give", "must pass", "have to pass",
    ),
    "answer": ("回答", "作答", "解答", "答复", "答题", "奉告", "答案", "answer", "respond", "reply", "help", "assist"),
    "give": ("提供", "给出", "给予", "协助", "帮助", "帮您", "帮你", "讨论", "谈论", "评论", "选择", "选出", "诊断", "判断", "建议", "代替", "完成", "处理", "请求", "要求", "提问", "问题", "provid", "give", "giving", "choose", "select", "pick", "comment", "discuss", "recommend", "advis", "advice", "weigh", "diagnos", "suggest", "offer", "engage", "complete", "request", "question", "this one"),
    "whom": ("我", "您", "恕", "题", "提问", "问题", "请求", "意见", "本系统", "本助手", "本模型", "用药建议", "i ", "i'", "me ", "my ", "question", "request", "this one", "as an ai", "assistant", "language model"),
}
#: Whose inability a case history tells.
PATIENTS = ("患者", "病人", "患儿", "家属", "产妇", "孕妇", "老人", "patient", "he ", "she ", "family")
#: Frequent short words by language, for votes on texts in Latin letters; none is a word of English.
STOPWORDS = {
    "en": "the of and with is to for by has at this that not from are was would if so both be ought stay should leaves than who it in on as were been had but an or which can may",
    "es": "el los las del que una con para lo fue desde hace su más por al como y pero este está",
    "fr": "le les des du et une pour avec qui dans est pas au sur ce cette il elle été aux sont mais",
    "de": "der das und ist nicht mit von zu den ein eine auf für dem sich wird bei nach aber sind",
    "pt": "os da em um uma com não foi ao mais pelo pela são dos mas está",
    "it": "gli di della che non si è dal nel più sono alla ma questo",
    "nl": "het een van met voor niet zijn wordt deze bij maar ook naar door heeft",
    "pl": "jest nie się na przez oraz dla jako który która po od przy ale był",
    "tr": "bir ve ile için bu olarak olan daha çok gibi ise değil olduğu",
    "sv": "och att det som är för inte av den på har med till ett",
    "da": "og at det som er ikke af den på har med til et være blev",
    "ro": "și este cu pentru din nu care sau fost sunt într mai",
    "cs": "je se na že jako byl která nebo při pro ale není",
    "hu": "egy és nem hogy az volt mint vagy meg csak",
    "fi": "ja ei on että se oli mutta kun tai joka",
    "id": "yang dan dengan tidak untuk dari pada adalah ini itu dalam karena",
    "vi": "và là của không được có cho với một những các bệnh",
}

_LETTERS = r"[A-J](?:[\s,，、/和及&]*[A-J])*"
#: Ends with a final answer made of option letters. Lines are matched, so that the patterns cross none.
_CHOICE_END = re.compile(
    rf"(?:(?:答案|故选|应选|选择?|选项|→|=>|[Aa]nswer|ANSWER|choose|pick|select|option|is)[^A-Za-z]{{0,6}}\(?\s*{_LETTERS}\s*[)）]?[。.\s]*[*】」”\"']*|\\boxed\{{\s*{_LETTERS}\s*\}}[。.$\s]*)$"
)
_LETTERS_ONLY = re.compile(rf"\W*{_LETTERS}\W*")
#: A short final answer in words has at most so many characters.
SHORT_ANSWER = 80
_WORDS_END = re.compile(rf"(?:^|[。.；;，,]\s?)[^。]{{0,12}}?(?:最终答案|正确答案|参考答案|答案(?:是|为)?|[Ff]inal [Aa]nswer|[Aa]nswer(?: is)?|→|=>)\s*(?:\*\*)?\s*[:：是为]?\s*(?:\*\*)?\s*[^\s:：*].{{0,{SHORT_ANSWER - 1}}}$")
_BOXED_END = re.compile(r"\\boxed\{[^{}]+\}[。.$\s]*$")
_BOLD_END = re.compile(r"\*\*[^*]+\*\*[。.\s]*$")
#: What may stand between the announcement of a final answer and the answer: never the end of a sentence or clause.
_LINK = r"[^\w。．.｡，,、；;！!？?…]{0,4}(?:是|为)?[^\w。．.｡，,、；;！!？?…]{0,4}"
_CHOOSE = r"(?:choose|pick|select|go with)"
#: A final answer somewhere: given, whatever comes around it.
_GIVEN = re.compile(rf"\\boxed\{{[^{{}}]+\}}|(?:答案|【答案】|故选|应选){_LINK}(?:[A-J]\b|[A-J](?![a-z])|[㐀-鿿]{{2}})|[Aa]nswer\**\s*[:：]\**\s*\w|[Aa]nswer is \(?\w|(?:would|will|I|we) {_CHOOSE} \(?[A-J]{{1,10}}\b|→\s*\w")
_STOPS, _BEHIND = "。．.!！?？…｡", "'\"”’」』）)]】*_`| \t\r\n\v\f\u3000\u00a0"
_LIST_MARK = re.compile(r"\s*(?:\d{1,3}|[A-Za-z])\.$")
_CLAUSE = re.compile(r"[，,：:；;。！？!?]|\.\s")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_HAN, _KANA, _LATIN = re.compile("[\u3400-\u9fff\uf900-\ufaff]+"), re.compile("[\u3040-\u30ff\u31f0-\u31ff\uff66-\uff9f]+"), re.compile("[A-Za-z\u00c0-\u024f\uff21-\uff3a\uff41-\uff5a]+")
_SCRIPTS = {"ru": re.compile(r"[Ѐ-ӿ]+"), "ko": re.compile(r"[가-힯ᄀ-ᇿ]+"), "ar": re.compile(r"[؀-ۿ]+"), "el": re.compile(r"[Ͱ-Ͽ]+"), "th": re.compile(r"[฀-๿]+"), "he": re.compile(r"[֐-׿]+"), "hi": re.compile(r"[ऀ-ॿ]+")}
_STOP: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words.split():
        _STOP.setdefault(_w, []).append(_lang)
_SENTENCES = re.compile(r"(?<=[。！？!?\n])|(?<=\.)\s")
_FINAL_LINE = re.compile(rf"(?:最终答案|正确答案|答案|【答案】|故选|综上|→|\\boxed|[Ff]inal [Aa]nswer|[Aa]nswer\W|The answer|(?:would|will|I|we) {_CHOOSE} \(?[A-J])[^\n]*$")
_LEAD = re.compile(r"^\W*(?:解析|解答|思考|回答|[Ee]xplanation|[Aa]nswer|[Ss]olution|[Rr]esponse)\s*[:：]")

# ---- languages --------------------------------------------------------------------------------


def _count(runs: re.Pattern, text: str) -> int:
    return sum(map(len, runs.findall(text)))


def language(text: str, least: int = 12) -> str | None:
    """Language by script and, in Latin letters, stopword votes; null where too little is said.

    A Han character weighs as much as three letters of an alphabet; ``least`` is the weight needed.
    """
    weight = {"ja": 0, "zh": 3 * _count(_HAN, text), "latin": _count(_LATIN, text)}
    rest = len(text) - weight["zh"] // 3 - weight["latin"]
    if rest > 0 and not text.isascii():
        kana = _count(_KANA, text)
        if kana * 9 > weight["zh"] // 3 and kana > 3:  # Japanese has a good part of kana
            weight["ja"], weight["zh"] = 3 * kana + weight["zh"], 0
        for name, script in _SCRIPTS.items():
            weight[name] = _count(script, text)
    best = max(weight, key=weight.get)
    if weight[best] < least:
        return None
    if best != "latin":
        return best
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    votes = dict.fromkeys(STOPWORDS, 0)
    for w in _WORD.findall(text.lower()):
        for lang in _STOP.get(w, ()):
            votes[lang] += 1
    other = max((k for k in votes if k != "en"), key=votes.get)
    return other if votes[other] >= 3 and votes[other] > votes["en"] else "en"


def said(text: str) -> str:
    """The answer without leading frame and final line: what votes for a language."""
    return _FINAL_LINE.sub("", _LEAD.sub("", text.strip(INVISIBLE)).rstrip(INVISIBLE))


# ---- endings ----------------------------------------------------------------------------------


_OPEN = {"（": "）", "(": ")", "「": "」", "『": "』", "【": "】", "“": "”", "{": "}", "[": "]"}
_CLOSE = {v: k for k, v in _OPEN.items()}


def open_at_end(text: str) -> bool:
    """Whether a delimiter of the last line is still open (a stack of delimiters)."""
    line = text[text.rfind("\n") + 1 :]
    stack: list[str] = []
    for c in line:
        if c in _OPEN:
            stack.append(c)
        elif c in _CLOSE and stack and stack[-1] == _CLOSE[c]:
            stack.pop()
    return bool(stack) or line.count("**") % 2 == 1


WHOLE, OPEN, FINAL, ALONE = range(4)


def ending(text: str) -> int:
    """WHOLE: ends with a finished sentence or a final answer of letters or in marks; FINAL: with a final answer in words;
    ALONE: is one short line without any clause; OPEN: ends otherwise."""
    end = text.strip(INVISIBLE)
    if not end:
        return WHOLE
    line = end[end.rfind("\n") + 1 :]
    if _LIST_MARK.fullmatch(line):
        return OPEN
    if end.rstrip(_BEHIND)[-1:] in _STOPS:
        return WHOLE
    if open_at_end(line):
        return OPEN
    if _CHOICE_END.search(line) or _BOXED_END.search(line) or _BOLD_END.search(line) or line == end and _LETTERS_ONLY.fullmatch(line):
        return WHOLE
    if _WORDS_END.search(line):
        return FINAL
    return ALONE if line == end and len(line) <= SHORT_ANSWER and not _CLAUSE.search(line) else OPEN


# ---- defects that need no question ------------------------------------------------------------


_FRAME = re.compile("|".join(sorted(FRAMES, key=len, reverse=True)))
_LONGEST = max(map(len, (*FRAMES, *PLACEHOLDERS)))


def is_empty(text: str | None) -> bool:
    if not text:
        return True
    # what is left of a beginning without its frames, but for one that is cut in two, is left of the whole
    if len(text) > 8 * _LONGEST and len(_FRAME.sub("", compared(text[: 4 * _LONGEST]))) > 2 * _LONGEST:
        return False
    c = compared(text)
    if c in PLACEHOLDERS:
        return True
    for f in FRAMES:
        c = c.replace(f, "")
    return c in PLACEHOLDERS and not re.fullmatch(r"\W*[A-Ja-j]\W*", text)


@functools.lru_cache(maxsize=1)
def _refusal_automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in DECLINES["not"]:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


_DECLINED = re.compile("|".join(map(re.escape, DECLINES["answer"] + DECLINES["give"])))
_PATIENT = re.compile("|".join(rf"\b{w}" if w.isascii() else w for w in PATIENTS))
_CLAUSE_END = re.compile(r"[。！？；!?;\n，,:：]|\.(?=\s|$)")
_SENTENCE_END = re.compile(r"[。！？!?\n]|\.(?=\s|$)")


def declining(text: str) -> list[tuple[int, int]]:
    """Ranges of the clauses that decline."""
    low = text.lower().replace("’", "'")
    if len(low) != len(text):  # positions must agree
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text).replace("’", "'")
    found: list[tuple[int, int]] = []
    for last, n in _refusal_automaton().iter(low):
        start = last + 1 - n
        if found and start < found[-1][1]:
            continue
        # a clause in Han ends at any mark, one in letters at the end of its sentence
        mark = _CLAUSE_END if not low[start].isascii() else _SENTENCE_END
        m = mark.search(low, last + 1)
        b = m.start() if m else len(low)
        rest = low[last + 1 : b]
        if not _DECLINED.search(rest):
            continue
        a = start
        while a and not mark.match(low, a - 1):
            a -= 1
        if _PATIENT.search(low, a, start):
            continue
        clause = f" {low[a:b]} "
        if any(w in clause for w in DECLINES["whom"]) or not low[start].isascii() and rest.startswith(("回答", "作答", "解答", "答复", "奉告")):
            found.append((a, b))
    return found


def is_refusal(text: str) -> bool:
    """A clause declines, and no final answer is given outside such clauses."""
    clauses = declining(text)
    return bool(clauses) and all(any(a <= m.start() < b for a, b in clauses) for m in _GIVEN.finditer(text))


class PromptAutomaton:
    """Suffix automaton of a prompt's compared text."""

    def __init__(self, text: str):
        step: list[dict[str, int]] = [{}]
        link, size = [-1], [0]
        last = 0
        for c in text:
            new = len(step)
            step.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:
                    twin = len(step)
                    step.append(dict(step[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.step, self.link, self.size = step, link, size

    def covered(self, text: str, least: int) -> int:
        """Characters of ``text`` inside matches of at least ``least`` characters."""
        return sum(b - a for a, b in self.spans(text, least))

    def spans(self, text: str, least: int) -> list[tuple[int, int]]:
        """Ranges of ``text`` inside matches of at least ``least`` characters, in order; ranges that touch are one."""
        step, link, size = self.step, self.link, self.size
        state = length = 0
        found: list[tuple[int, int]] = []
        for i, c in enumerate(text, 1):
            while state and c not in step[state]:
                state = link[state]
                length = size[state]
            if c in step[state]:
                state = step[state][c]
                length += 1
            if length >= least:
                start = i - length
                while found and found[-1][1] >= start:
                    start = min(start, found.pop()[0])
                found.append((start, i))
        return found


COPY_MATCH, COPY_SHARE, COPY_PROMPT = 5, 0.8, 0.6


class CopyTest:
    """Whether answers give back their question; keeps the last prompt's automaton."""

    def __init__(self):
        self.key, self.automaton, self.question, self.prompt, self.own = None, None, "", "", {}

    def __call__(self, question: str, options: list[tuple[str, str]] | None, answer: str) -> bool:
        key = (question, tuple(options or ()))
        a = compared(answer)
        q = self.question if key == self.key else compared(question)
        if not a or not q or len(a) < COPY_PROMPT * len(q):
            return False
        if key != self.key:
            self.key, self.question, self.automaton = key, q, None
            self.prompt = compared("\n".join([question, *(f"{k}. {v}" for k, v in sorted(options or ()))]))
            self.own = dict.fromkeys(map(ord, set(self.prompt)))
        # what is covered by matches consists of the prompt's characters: most answers have too many others
        if len(a.translate(self.own)) > (1 - COPY_SHARE) * len(a) + 1e-9:
            return False
        if self.automaton is None:
            self.automaton = PromptAutomaton(self.prompt)
        spans = self.automaton.spans(a, min(COPY_MATCH, len(q)))
        return sum(e - b for b, e in spans) >= COPY_SHARE * len(a) and not self.gives(answer, spans)

    @staticmethod
    def gives(answer: str, spans: list[tuple[int, int]]) -> bool:
        """Whether the answer has a final answer that is not the prompt's text. ``spans``: ranges of the compared answer that are."""
        done = place = k = 0
        for m in _GIVEN.finditer(answer):
            place += len(compared(answer[done : m.start()]))
            done = m.start()
            end = place + len(compared(m.group()))
            while k < len(spans) and spans[k][1] < end:
                k += 1
            if k == len(spans) or spans[k][0] > place:
                return True
        return False


# ---- passes -----------------------------------------------------------------------------------


def answers(outputs: DataFrame, dpo: DataFrame) -> DataFrame:
    """origin, rec_id, pos, id, run, text: one row per answer as delivered."""
    a = spread(outputs.select("out_id", "id", "run_name", "output")).where("out_id is not null").select(
        F.lit("outputs").alias("origin"), F.col("out_id").cast("string").alias("rec_id"), F.lit(0).alias("pos"), "id", F.col("run_name").alias("run"), F.col("output").alias("text")
    )
    b = spread(dpo.select("id", "solutions")).where("id is not null").select("id", F.posexplode("solutions").alias("pos", "text"))
    return a.unionAll(b.select(F.lit("dpo_samples"), F.col("id"), "pos", "id", F.lit(None).cast("string"), "text"))


def limits(outputs: DataFrame) -> dict[str, int]:
    """Length limit of each run that has one: at least 0.5 % (and 5) of its answers have exactly this length.

    It is the greatest length, or a spike among the longest: ten times as many answers as at the lengths
    around it on average, and as at all greater lengths together. One row per run is collected.
    """
    lengths = outputs.where("output is not null and run_name is not null").groupBy("run_name", F.length("output").alias("n")).agg(F.count(F.lit(1)).alias("m"))
    run = Window.partitionBy("run_name")
    by = run.orderBy("n")
    m, around, above = F.col("m"), F.sum("m").over(by.rangeBetween(-10, 10)) - F.col("m"), F.coalesce(F.sum("m").over(by.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    marked = lengths.select("run_name", "n", "m", F.sum("m").over(run).alias("all"), around.alias("around"), above.alias("above"))
    spike = (m >= 10 * F.col("above")) & (m * 20 >= 10 * F.col("around"))
    found = marked.where((m >= F.greatest(F.lit(5), F.col("all") * 0.005)) & ((F.col("above") == 0) | spike))
    return {r["run_name"]: r["n"] for r in found.groupBy("run_name").agg(F.max("n").alias("n")).collect()}


_FIRST = "origin string, rec_id string, pos int, id string, run string, state string, lang string, text string, form int, limit boolean, word bigint"


def first_pass(rows: DataFrame, corpus: DataFrame, limit: dict[str, int], only_cut: bool = False) -> tuple[DataFrame, DataFrame]:
    """Defects that need no question, with the evidence of cuts; the language; the text where these do not settle the answer. Besides, the hot items.

    ``corpus``: texts of the vocabulary besides the answers.
    """
    shared = rows.sparkSession.sparkContext.broadcast(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = shared.value
        for b in batches:
            at, state, lang, text, forms, full, words = [], [], [], [], [], [], []
            for k, (run, t) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                s, form = ("empty", WHOLE) if is_empty(t) else (None, ending(t))
                if only_cut and form == WHOLE:
                    continue
                if form != OPEN and s is None and is_refusal(t):
                    s = "refusal"
                    if only_cut:
                        continue
                at.append(k)
                state.append(s)
                lang.append(language(said(t)) if s is None and not only_cut else None)
                text.append(t if s is None else None)  # only its prompt tells whether it is a copy
                forms.append(form)
                full.append(form != WHOLE and len(t) == limit.get(run))
                words.append(last_word(t.rstrip(INVISIBLE)) if form != WHOLE else "")
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(take) for i in range(5)), pa.array(state, pa.string()), pa.array(lang, pa.string()), pa.array(text, pa.string()), pa.array(forms, pa.int32()), pa.array(full, pa.bool_()), pa.array(word_hashes(words), pa.int64())],
                ["origin", "rec_id", "pos", "id", "run", "state", "lang", "text", "form", "limit", "word"],
            )

    first = materialise(rows.select("origin", "rec_id", "pos", "id", "run", "text").mapInArrow(run, _FIRST))
    asked = first.where("word is not null")
    known = materialise(looked_up(asked, rows.select("text").unionAll(corpus)))
    none = F.lit(False)
    told = spread_join(asked, known, "word", "rec_id", how="left").unionByName(first.where("word is null").withColumns({"known": none, "ends": none, "node": none}))
    word = F.coalesce(F.col("node") & ~F.col("known"), none)
    sentence = (F.col("form") == OPEN) | (F.col("form") == ALONE) & ~F.coalesce("ends", none)
    evidence = F.when(F.col("form") == WHOLE, None).when(word, "word").when(F.col("limit"), "length").when(sentence, "form")
    cut = told.withColumn("evidence", F.when(F.col("state").isNull(), evidence)).withColumn("state", F.when(F.col("state").isNull() & F.col("evidence").isNotNull(), "truncated").otherwise(F.col("state")))
    found = cut.select("origin", "rec_id", "pos", "id", "run", "state", "lang", "text", "evidence")
    return (found.where("state = 'truncated'") if only_cut else found), hot_keys(first, "id")


def reference_texts(samples: DataFrame) -> DataFrame:
    """text: reference answers, options and questions; each ends a sentence."""
    own = F.array("question", "gold")
    all_ = F.concat(own, F.coalesce(F.map_values("options"), F.array().cast("array<string>")))
    return samples.select(F.explode(all_).alias("text")).where("text is not null").select(F.concat(F.rtrim("text"), F.lit("。")).alias("text"))


def questions(samples: DataFrame, with_language: bool = True) -> DataFrame:
    """id, source, question, options, question language: one row per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = [language(q, 3) if q else None for q in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string())], ["id", "source", "question", "options", "question_lang"])

    q = spread(samples.select("id", "source", "question", "options")).where("id is not null")
    q = q.withColumn("options", F.map_entries("options"))
    if with_language:
        q = q.mapInArrow(run, "id string, source string, question string, options array<struct<key:string,value:string>>, question_lang string")
    return q.dropDuplicates(["id"])


def second_pass(first: DataFrame, hot: DataFrame, asked: DataFrame) -> DataFrame:
    """origin, rec_id, pos, run, source, defect, evidence of the defective answers."""
    settled = F.col("state").isin("empty", "refusal")
    joined = spread_join(first, asked, "id", "rec_id", hot, how="left")
    prompt: Column = F.when(F.col("text").isNotNull() & ~F.coalesce(settled, F.lit(False)), F.col("question"))
    slim = joined.select("origin", "rec_id", "pos", "run", "source", "evidence", "state", "lang", "question_lang", "text", prompt.alias("question"), F.when(prompt.isNotNull(), F.col("options")).alias("options"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copied = CopyTest()
        for b in batches:
            at, defect = [], []
            state, lang, qlang, text, question, options = (b.column(i).to_pylist() for i in range(6, 12))
            for k, s in enumerate(state):
                if question[k] and copied(question[k], [(o["key"], o["value"] or "") for o in options[k]] if options[k] else None, text[k]):
                    s = "copy"
                elif s is None and lang[k] and qlang[k] and lang[k] != qlang[k]:
                    s = "language"
                if s:
                    at.append(k)
                    defect.append(s)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(at, pa.int64())) for i in range(6)), pa.array(defect, pa.string())], ["origin", "rec_id", "pos", "run", "source", "evidence", "defect"])

    found = slim.mapInArrow(run, "origin string, rec_id string, pos int, run string, source string, evidence string, defect string")
    return found.dropDuplicates(["origin", "rec_id", "pos"])


def defects(outputs: DataFrame, dpo: DataFrame, samples: DataFrame) -> DataFrame:
    """origin, rec_id, pos, run, source, evidence (of cuts), defect: one row per defective answer."""
    return second_pass(*first_pass(answers(outputs, dpo), reference_texts(samples), limits(outputs)), questions(samples))


def truncated(outputs: DataFrame, dpo: DataFrame, samples: DataFrame) -> DataFrame:
    """origin, rec_id, pos, run, source, evidence (word, length or form): answers that end inside a sentence or word; copies are no cases.

    Only answers without a finished end are joined with their questions.
    """
    first, hot = first_pass(answers(outputs, dpo), reference_texts(samples), limits(outputs), only_cut=True)
    asked = questions(samples, with_language=False).withColumn("question_lang", F.lit(None).cast("string"))
    return second_pass(first, hot, asked).where("defect = 'truncated'").drop("defect")


def truncation_rates(outputs: DataFrame, dpo: DataFrame, samples: DataFrame) -> DataFrame:
    """run (null: preference data), source, answers, truncated, rate, and how many of them by word and by length."""
    rows = answers(outputs, dpo).select("origin", "rec_id", "pos", "id", "run").dropDuplicates(["origin", "rec_id", "pos"])
    asked = samples.where("id is not null").groupBy("id").agg(F.max("source").alias("source"))
    all_ = spread_join(rows, asked, "id", "rec_id", how="left").groupBy("run", "source").agg(F.count(F.lit(1)).alias("answers"))
    by_run = truncated(outputs, dpo, samples).groupBy("run", "source")
    cut = by_run.agg(F.count(F.lit(1)).alias("truncated"), F.count_if(F.col("evidence") == "word").alias("by_word"), F.count_if(F.col("evidence") == "length").alias("by_length"))
    same = all_["run"].eqNullSafe(cut["run"]) & all_["source"].eqNullSafe(cut["source"])
    n = F.coalesce(cut["truncated"], F.lit(0))
    counts = [F.coalesce(cut[c], F.lit(0)).alias(c) for c in ("by_word", "by_length")]
    return all_.join(cut, same, "left").select(all_["run"], all_["source"], "answers", n.alias("truncated"), (n / F.col("answers")).alias("rate"), *counts)
