"""Reports on graded runs: tallies, intervals, comparisons, buckets, replay data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpuloom.functions.extract import keep_ends, split_thinking
from corpuloom.functions.stats import share, wilson

#: Order in which buckets are shown.
SHOWN = ("regression", "dpo_fix", "mixed", "all_wrong", "all_correct")
BUCKETS = ("regression", "dpo_fix", "all_correct", "all_wrong", "mixed")


def tally(graded: DataFrame, *by: str) -> DataFrame:
    """``by``, n, correct, abstained, acc, abstain_rate, ci_low, ci_high. No verdict counts as not correct."""
    t = graded.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"), F.count_if(F.col("correct").isNull()).alias("abstained"))
    low, high = wilson(F.col("correct"), F.col("n"))
    return t.select(*by, "n", "correct", "abstained", share(F.col("correct"), F.col("n")).alias("acc"), share(F.col("abstained"), F.col("n")).alias("abstain_rate"), low.alias("ci_low"), high.alias("ci_high"))


def against_baseline(tallies: DataFrame, base: str, run: str = "run", on: str = "set_name") -> DataFrame:
    """Each run's difference to the baseline on the same set, in points, and its class.

    flat: the baseline's accuracy lies in the run's interval; else up or down. The baseline itself, and runs without baseline, have none.
    """
    b = tallies.where(F.col(run) == base).select(on, F.col("acc").alias("base_acc"))
    points = F.when(F.col(run) != base, (F.col("acc") - F.col("base_acc")) * 100)
    kind = F.when(F.col("base_acc").between(F.col("ci_low"), F.col("ci_high")), "flat").when(F.col("acc") > F.col("base_acc"), "up").otherwise("down")
    return tallies.join(b, on, "left").select(run, on, "n", "acc", "base_acc", points.alias("delta"), F.when((F.col(run) != base) & F.col("base_acc").isNotNull(), kind).alias("delta_class"))


def transitions(before: DataFrame, after: DataFrame, *by: str) -> DataFrame:
    """fixed (wrong before, right after), broken, net per ``by`` over questions in both runs; no verdict is wrong."""
    a = before.select("id", *by, F.coalesce("correct", F.lit(False)).alias("was"))
    b = after.select("id", F.coalesce("correct", F.lit(False)).alias("now"))
    both = a.join(b, "id")
    fixed, broken = F.count_if(~F.col("was") & F.col("now")), F.count_if(F.col("was") & ~F.col("now"))
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"), fixed.alias("fixed"), broken.alias("broken"), (fixed - broken).alias("net"))


def bucket(base: Column, tuned: list[Column], dpo: Column | None) -> Column:
    """Story bucket of a question by its verdicts in the base run, tuned runs and the preference run (in this order of rules).

    A base run that abstains has not answered right: the preference run may have mended it.
    """
    every = [base, *tuned, *([dpo] if dpo is not None else [])]

    def is_(v: Column, value: bool) -> Column:
        return F.coalesce(v == F.lit(value), F.lit(False))

    def none_is(vs: list[Column], value: bool) -> Column:
        out = F.lit(True)
        for v in vs:
            out = out & ~is_(v, value)
        return out

    known = F.lit(False)
    for v in tuned:
        known = known | v.isNotNull()
    regression = is_(base, True) & known & none_is(tuned, True)
    fix = (~is_(base, True) & is_(dpo, True)) if dpo is not None else F.lit(False)
    return F.when(regression, BUCKETS[0]).when(fix, BUCKETS[1]).when(none_is(every, False), BUCKETS[2]).when(none_is(every, True), BUCKETS[3]).otherwise(BUCKETS[4])


def common_questions(graded: DataFrame, runs: list[str], *by: str) -> DataFrame:
    """``by``, id and a column of verdicts per run, of questions that every run answered; runs without any answer are ignored."""
    there = graded.where(F.col("run").isin(runs)).withColumn("__g", F.lit(0))
    groups = ["__g", *by]
    wide = there.groupBy(*groups, "id").agg(F.count_distinct("run").alias("__n"), *(F.max(F.when(F.col("run") == r, F.col("correct"))).alias(r) for r in runs))
    of = there.groupBy(*groups).agg(F.count_distinct("run").alias("__all"))
    return wide.join(of, groups).where("__n = __all").drop("__n", "__all", "__g")


def first_of_bucket(bucketed: DataFrame, k: int = 8, *by: str) -> DataFrame:
    """The first k ids, as text, of each bucket."""
    order = W.partitionBy(*by, "bucket").orderBy("id")
    return bucketed.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def answer_view(output: Column, most: int = 7000) -> list[Column]:
    """Columns of an answer as shown: thinking cut at its end, conclusion without its middle, true lengths."""
    thinking, conclusion = split_thinking(output)
    room = F.lit(most)
    return [
        F.left(thinking, room).alias("thinking"), (F.length(thinking) > most).alias("thinking_cut"), keep_ends(conclusion, most).alias("conclusion"),
        F.length(thinking).alias("thinking_chars"), F.length(conclusion).alias("conclusion_chars"),
    ]


def with_verdicts(outputs: DataFrame, scored: DataFrame) -> DataFrame:
    """The answers (id, run, output) with correct and method of ``scored`` (id, run), null where there is none; verdicts without answer are dropped."""
    return outputs.join(scored.select("id", "run", "correct", "method"), ["id", "run"], "left")


def replay(bucketed: DataFrame, samples: DataFrame, answers: DataFrame, most: int = 7000, labels: dict[str, str] | None = None) -> DataFrame:
    """One row per chosen question: id, set_name (if given), bucket, label, question, options, gold, meta, and a map of run to its answer as shown."""
    shown = answers.select("id", "run", F.struct(*answer_view(F.col("output"), most), "correct", "method").alias("answer"))
    in_order = F.array_sort(F.collect_list(F.struct("run", "answer")), lambda a, b: F.when(a["run"] < b["run"], -1).when(a["run"] > b["run"], 1).otherwise(0))
    per = shown.join(bucketed.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.map_from_entries(in_order).alias("answers"))
    label = F.col("bucket")
    for name, text in (labels or {}).items():
        label = F.when(F.col("bucket") == name, text).otherwise(label)
    extra = [c for c in ("set_name",) if c in bucketed.columns]
    meta = [c for c in ("meta",) if c in samples.columns]
    asked = samples.dropDuplicates(["id"]).select("id", "source", "question", "options", "gold", *meta)
    return bucketed.select("id", *extra, "bucket", label.alias("label")).join(asked, "id").join(per, "id", "left")


def filtered(questions: DataFrame, set_name: str = "all", bucket_name: str = "all") -> DataFrame:
    """The questions of a set and a bucket; ``all`` is any."""
    for column, value in (("set_name", set_name), ("bucket", bucket_name)):
        if value != "all":
            questions = questions.where(F.col(column) == value)
    return questions


def buckets_present(questions: DataFrame) -> DataFrame:
    """place, bucket of the buckets that occur, in the order in which they are shown."""
    place = F.array_position(F.array(*map(F.lit, SHOWN)), F.col("bucket")) - 1
    return questions.select("bucket").distinct().select(place.alias("place"), "bucket").where("place >= 0")


def within_base(tallies: DataFrame, base: str, run: str = "run", on: str = "set_name") -> DataFrame:
    """As :func:`against_baseline` the other way: flat where a run's accuracy lies in the baseline's interval."""
    b = tallies.where(F.col(run) == base).select(on, F.col("acc").alias("base_acc"), F.col("ci_low").alias("base_low"), F.col("ci_high").alias("base_high"))
    kind = F.when(F.col("acc").between(F.col("base_low"), F.col("base_high")), "flat").when(F.col("acc") > F.col("base_acc"), "up").otherwise("down")
    return tallies.join(b, on, "left").select(run, on, F.when((F.col(run) != base) & F.col("base_acc").isNotNull(), kind).alias("delta_class"))


def markdown_table(tallies: DataFrame, base: str | None = None) -> str:
    """Summary table of tallies with a ``run`` column (one row per run is collected)."""
    rows = sorted(tallies.collect(), key=lambda r: r["run"])
    ref = next((r["acc"] for r in rows if r["run"] == base), None)
    lines = ["| run | n | acc | 95% CI | abstain | delta |", "|---|---|---|---|---|---|"]
    for r in rows:
        delta = "—" if ref is None or r["run"] == base else f"{(r['acc'] - ref) * 100:+.1f}"
        lines.append(f"| {r['run']} | {r['n']} | {r['acc'] * 100:.1f} | {r['ci_low'] * 100:.1f}–{r['ci_high'] * 100:.1f} | {r['abstain_rate'] * 100:.1f} | {delta} |")
    return "\n".join(lines)
