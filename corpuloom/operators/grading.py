"""Grading: rule verdicts, pluggable judge, solution classes, preference pairs, calibration.

Verdicts have three values: true, false, and null for an abstention.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuloom.functions.extract import extract
from corpuloom.functions.stats import share
from corpuloom.functions.text import first_clause, norm_text, sorted_letters
from corpuloom.operators.sampling import SEED, hash_order
from corpuloom.sources.adapters import render_question

THINK_OPEN, THINK_CLOSE = "<think>\n", "\n</think>\n\n"
CALIBRATION_RATE, CALIBRATION_JUDGED = 0.95, 50
#: What a judge reads of question, answer and output (characters; the output's end).
JUDGE_QUESTION, JUDGE_GOLD, JUDGE_OUTPUT = 1500, 500, 1500


def declared(output: Column, options: Column) -> Column:
    return extract(output, options.isNotNull())


def rule_verdict(gold: Column, options: Column, declaration: Column) -> Column:
    """Verdict of the rules on a declared answer.

    Choice: the letters are the answer's, or not. Open: equal to the answer, as a whole or in the
    first clause, is right; anything else is left open, never wrong. No declaration: left open.
    """
    choice = declaration == sorted_letters(F.upper(gold))
    target = norm_text(gold)
    same = (norm_text(declaration) == target) | (norm_text(first_clause(declaration)) == target)
    open_ = F.when((target != "") & same, F.lit(True))
    return F.when(declaration.isNull(), F.lit(None).cast("boolean")).when(options.isNotNull(), choice).otherwise(open_)


def grade(samples: DataFrame, outputs: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """id, declaration, correct, method of every sample; ``outputs``: (id, output), ``judged``: (id, correct) of an external judge.

    Samples without output get no verdict (``missing``). The judge's word counts only where the
    rules abstain.
    """
    rows = samples.join(outputs.withColumn("__there", F.lit(True)), "id", "left").withColumn("declaration", declared(F.col("output"), F.col("options")))
    rows = rows.withColumn("__rule", rule_verdict(F.col("gold"), F.col("options"), F.col("declaration")))
    if judged is not None:
        rows = rows.join(judged.select("id", F.col("correct").alias("__judge"), F.lit(True).alias("__asked")), "id", "left")
    else:
        rows = rows.withColumn("__judge", F.lit(None).cast("boolean")).withColumn("__asked", F.lit(None).cast("boolean"))
    method = F.when(F.col("__there").isNull(), "missing").when(F.col("__rule").isNotNull(), "rule").when(F.col("__asked"), "llm").otherwise("abstain")
    return rows.select("id", "declaration", F.when(F.col("__there"), F.coalesce("__rule", "__judge")).alias("correct"), method.alias("method"))


def judge_prompts(samples: DataFrame, outputs: DataFrame) -> DataFrame:
    """id, question, gold, output as a judge reads them, of samples on which the rules abstain."""
    left = grade(samples, outputs).where("method = 'abstain'").select("id")
    rows = samples.join(outputs, "id").join(left, "id", "left_semi")
    return rows.select("id", F.left("question", F.lit(JUDGE_QUESTION)).alias("question"), F.left("gold", F.lit(JUDGE_GOLD)).alias("gold"), F.right("output", F.lit(JUDGE_OUTPUT)).alias("output"))


def solution_class(gold: Column, options: Column, declaration: Column, arbitrated: Column | None = None) -> Column:
    """correct, wrong or drop. ``arbitrated``: the judge's word on declared answers that the rules leave open.

    Without arbitration such answers are wrong; where the arbiter abstains they are dropped.
    """
    rule = rule_verdict(gold, options, declaration)
    rest = F.lit("wrong") if arbitrated is None else F.when(arbitrated.isNull(), "drop").when(arbitrated, "correct").otherwise("wrong")
    return F.when(rule.isNotNull(), F.when(rule, "correct").otherwise("wrong")).when(declaration.isNull(), "drop").otherwise(rest)


def exploded(solutions: DataFrame) -> DataFrame:
    """id, i, solution of (id, solutions); ids once, null solutions left out."""
    once = solutions.where("id is not null").dropDuplicates(["id"])
    return once.select("id", F.posexplode("solutions").alias("i", "solution")).where("solution is not null")


def classified(solutions: DataFrame, samples: DataFrame, labels: DataFrame | None = None, arbitrated: DataFrame | None = None) -> DataFrame:
    """id, i, solution, cls.

    With ``labels`` (key = id#i, cls) the class is looked up, and drop where there is none. Else the rules tell, and
    ``arbitrated`` (key, correct), the words of a judge, decides on declared answers that they leave open; an answer that the judge has
    not been asked about, or abstains on, is dropped. Without a judge such answers are wrong.
    """
    each = exploded(solutions).withColumn("key", F.concat("id", F.lit("#"), F.col("i").cast("string")))
    if labels is not None:
        return each.join(labels.select("key", "cls"), "key", "left").select("id", "i", "solution", F.coalesce("cls", F.lit("drop")).alias("cls"))
    rows = each.join(samples.select("id", "gold", "options").dropDuplicates(["id"]), "id")
    word = None
    if arbitrated is not None:
        rows, word = rows.join(arbitrated.select("key", F.col("correct").alias("__word")), "key", "left"), F.col("__word")
    return rows.select("id", "i", "solution", solution_class(F.col("gold"), F.col("options"), declared(F.col("solution"), F.col("options")), word).alias("cls"))


def to_arbitrate(solutions: DataFrame, samples: DataFrame) -> DataFrame:
    """key, id, solution of the declared answers that the rules leave open: what a judge is to be asked."""
    rows = exploded(solutions).join(samples.select("id", "gold", "options").dropDuplicates(["id"]), "id")
    read = rows.withColumn("__d", declared(F.col("solution"), F.col("options")))
    left = read.where(F.col("__d").isNotNull() & rule_verdict(F.col("gold"), F.col("options"), F.col("__d")).isNull())
    return left.select(F.concat("id", F.lit("#"), F.col("i").cast("string")).alias("key"), "id", "solution")


def pairs(classes: DataFrame, k: int = 2, seed: int = SEED) -> DataFrame:
    """id, rank, chosen, rejected: at most k pairs per question of the k shortest right solutions and wrong ones by hash.

    Ties of length go to the earlier solution. With fewer wrong than right ones, wrong ones are used again in turn.
    """
    per = W.partitionBy("id")
    right = classes.where("cls = 'correct'").withColumn("rank", F.row_number().over(per.orderBy(F.length("solution"), "i"))).where(F.col("rank") <= k)
    key = hash_order(F.concat("id", F.lit("#"), F.col("i").cast("string")), seed)
    wrong = classes.where("cls = 'wrong'").withColumn("place", F.row_number().over(per.orderBy(key, "i"))).where(F.col("place") <= k)
    count = wrong.groupBy("id").agg(F.count(F.lit(1)).alias("wrongs"))
    wanted = right.join(count, "id").withColumn("place", F.pmod(F.col("rank") - 1, F.col("wrongs")) + 1)
    return wanted.join(wrong.select("id", "place", F.col("solution").alias("rejected"), F.col("i").alias("rejected_i")), ["id", "place"]).select(
        "id", "rank", F.col("i").alias("chosen_i"), "rejected_i", F.col("solution").alias("chosen"), "rejected"
    )


def pairs_compat(classes: DataFrame, k: int = 2, seed: int = SEED) -> DataFrame:
    """As :func:`pairs`, with wrong solutions drawn by Python's generator, seeded per question by the CRC-32 of its id.

    Enough wrong solutions are drawn without replacement, fewer with it. A question's solutions are one row's array, so
    its lists are as short as that; only numbers leave the JVM.
    """
    entry = F.struct(F.length("solution").alias("n"), "i", "solution")
    lists = classes.where("cls in ('correct', 'wrong')").groupBy("id").agg(
        F.slice(F.array_sort(F.collect_list(F.when(F.col("cls") == "correct", entry))), 1, k).alias("right"),
        F.array_sort(F.collect_list(F.when(F.col("cls") == "wrong", F.struct("i", "solution")))).alias("wrong"),
    )
    draw = F.pandas_udf(_numbers, T.ArrayType(T.IntegerType()))
    drawn = draw(F.crc32(F.col("id").cast("binary")), F.size("right"), F.size("wrong"), F.lit(seed))
    both = lists.where((F.size("right") > 0) & (F.size("wrong") > 0)).withColumn("drawn", drawn)
    each = both.select("id", F.posexplode("right").alias("rank", "r"), "wrong", "drawn")
    w = F.get("wrong", F.get("drawn", F.col("rank")))
    return each.select("id", (F.col("rank") + 1).alias("rank"), F.col("r.i").alias("chosen_i"), w["i"].alias("rejected_i"), F.col("r.solution").alias("chosen"), w["solution"].alias("rejected"))


def _numbers(crc: pd.Series, right: pd.Series, wrong: pd.Series, seed: pd.Series) -> pd.Series:
    out = []
    for c, k, n, s in zip(crc, right, wrong, seed):
        rng = random.Random(s + c % 10000)
        out.append(rng.sample(range(n), k) if n >= k else [rng.choice(range(n)) for _ in range(k)])
    return pd.Series(out)


def pair_records(made: DataFrame, samples: DataFrame, prompt: str = "{}") -> DataFrame:
    """id, rank, messages, rejected_response. ``prompt``: a template with one place for the rendered question."""
    before, _, after = prompt.partition("{}")
    asked = samples.dropDuplicates(["id"]).select("id", F.concat(F.lit(before), render_question(F.col("question"), F.col("options")), F.lit(after)).alias("__q"))
    return made.join(asked, "id").select("id", "rank", messages(F.col("__q"), F.col("chosen")).alias("messages"), F.col("rejected").alias("rejected_response"))


def messages(user: Column, assistant: Column) -> Column:
    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(turn("user", user), turn("assistant", assistant))


def think_messages(question: Column, cot: Column, gold: Column) -> Column:
    """Messages with the reasoning in front of the answer."""
    return messages(question, F.concat(F.lit(THINK_OPEN), cot, F.lit(THINK_CLOSE), gold))


def reasoning_rows(samples: DataFrame, pool: DataFrame) -> DataFrame:
    """id, messages of the samples still in the pool that have reasoning; the first of equal contents by id."""
    kept = samples.where(F.coalesce("cot", F.lit("")) != "").join(pool.select("id"), "id", "left_semi")
    first = W.partitionBy("question", "cot", "gold").orderBy("id")
    once = kept.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return once.select("id", think_messages(F.col("question"), F.col("cot"), F.col("gold")).alias("messages"))


def single_turn(conversations: DataFrame) -> DataFrame:
    """ord, messages of conversations of exactly one human and one model turn."""
    c = F.col("conversations")
    ok = (F.size(c) == 2) & (c[0]["from"] == "human") & (c[1]["from"] == "gpt")
    from corpuloom.functions.text import py_strip

    return conversations.where(ok).select("ord", messages(py_strip(c[0]["value"]), py_strip(c[1]["value"])).alias("messages"))


def calibration(verdicts: DataFrame) -> DataFrame:
    """One row of (correct, human_correct): total, judged, agree, disagree, abstain, rate, abstain_rate, fit.

    Abstentions are no judgements; an unlabelled human verdict counts as wrong.
    """
    human = F.coalesce("human_correct", F.lit(False))
    counts = verdicts.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("correct") == human).alias("agree"), F.count_if(F.col("correct") != human).alias("disagree"), F.count_if(F.col("correct").isNull()).alias("abstain"))
    rated = counts.withColumn("judged", F.col("agree") + F.col("disagree")).withColumn("rate", share(F.col("agree"), F.col("judged"))).withColumn("abstain_rate", share(F.col("abstain"), F.col("total")))
    return rated.withColumn("fit", (F.col("rate") >= CALIBRATION_RATE) & (F.col("judged") >= CALIBRATION_JUDGED)).select("total", "judged", "agree", "disagree", "abstain", "rate", "abstain_rate", "fit")
