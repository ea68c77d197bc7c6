"""End-to-end pipelines: the operators put together, with their reports.

Results stay DataFrames; only report figures (one row per set, run or level) reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuloom.operators import decontaminate, evaluation, grading, loadtest, sampling
from corpuloom.runtime import materialise
from corpuloom.sources import chat
from corpuloom.sources.readers import gate
from corpuloom.streaming.resume import remaining


@dataclass
class Pool:
    clean: DataFrame
    hits: DataFrame
    report: str


def build_pool(train: DataFrame, held: DataFrame, quarantine: DataFrame | None = None) -> Pool:
    """Decontaminate training samples against evaluation samples (both canonical) on their questions alone."""
    items = held.select("id", F.col("question").alias("text"), F.col("source").alias("eval_set"))
    texts = train.select("id", F.col("question").alias("text"))
    hits = materialise(decontaminate.scan(texts, items))
    # the report's hits are the best of each item; what is removed is all
    removing = materialise(decontaminate.contaminated_ids(decontaminate.contaminating(texts, items)))
    clean = train.join(removing, "id", "left_anti")
    rows = decontaminate.report(hits, items).orderBy("eval_set").collect()
    before, removed = train.count(), removing.count()
    lines = ["# Decontamination", "", f"{before} training rows, {removed} removed, {before - removed} kept.", "", "| set | size | contaminated | suspicious | unscannable |", "|---|---|---|---|---|"]
    lines += [f"| {r['eval_set']} | {r['size']} | {r['contaminated']} | {r['suspicious']} | {r['unscannable']} |" for r in rows]
    doubtful = decontaminate.top_suspicious(hits, items).orderBy("eval_set", "rank").collect()
    if doubtful:
        lines += ["", "## Suspicious", ""] + [f"- {r['eval_set']}: {r['item_id']} in {r['train_id']} ({r['ratio']:.3f})" for r in doubtful]
    if quarantine is not None:
        dropped = quarantine.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source").collect()
        if dropped:
            lines += ["", "## Dropped rows", ""] + [f"- {r['source']}: {r['n']}" for r in dropped]
    return Pool(clean, hits, "\n".join(lines) + "\n")


def build_finetuning(samples: DataFrame, pool: DataFrame, conversations: DataFrame, ratio: float = 0.15) -> DataFrame:
    """key, origin, messages, shuffle_key: reasoning rows of the pool mixed with single-turn conversations."""
    main = grading.reasoning_rows(samples, pool).select(F.col("id").alias("key"), "messages")
    general = grading.single_turn(conversations).select(F.col("ord").cast("string").alias("key"), "messages")
    return sampling.ratio_mix(main, general, "key", ratio)


def build_preferences(samples: DataFrame, solutions: DataFrame, labels: DataFrame | None = None, prompt: str = "{}", arbitrated: DataFrame | None = None) -> DataFrame:
    """Preference records of sampled solutions, classified by a cache of labels, or by rules and the words of a judge; an empty result fails the gate."""
    made = materialise(grading.pair_records(grading.pairs(materialise(grading.classified(solutions, samples, labels, arbitrated))), samples, prompt))
    gate(made.limit(1).count() == 1, "no preference pair came out")
    return made


def sample_solutions(samples: DataFrame, done: DataFrame | None, make_client: Callable[[], chat.Client], n: int = 6, count: int = 8000, offset: int = 0, prompt: str = "{}") -> DataFrame:
    """id, solutions, error for a shard of a prefix-stable sample of questions that have none yet."""
    asked = chat.prompts(sampling.sample(samples, "id", count, offset=offset), prompt, prompt)
    return chat.complete(remaining(asked, done) if done is not None else asked, make_client, n)


def evaluate_run(samples: DataFrame, outputs: DataFrame, run: str, judge: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(graded answers, tally per source) of one run."""
    graded = grading.grade(samples, outputs, judge).join(samples.select("id", F.col("source").alias("set_name")), "id").withColumn("run", F.lit(run))
    return graded, evaluation.tally(graded, "run", "set_name")


def calibrate(labelled: DataFrame, judge: DataFrame | None = None) -> DataFrame:
    """Agreement of the grader with human labels: rows of (id, gold, options, output, human_correct)."""
    graded = grading.grade(labelled.select("id", "gold", "options"), labelled.select("id", "output"), judge)
    return grading.calibration(graded.join(labelled.select("id", "human_correct"), "id"))


def calibration_sample(samples: DataFrame, open_rows: int = 120, choice_rows: int = 80) -> DataFrame:
    """Open questions, then choice questions, for labelling."""
    parts = [sampling.sample(samples.where(F.col("options").isNull()), "id", open_rows), sampling.sample(samples.where(F.col("options").isNotNull()), "id", choice_rows)]
    return parts[0].unionByName(parts[1])


def export_replay(samples: DataFrame, answers: DataFrame, base: str, tuned: list[str], dpo: str | None, per_bucket: int = 8, most: int = 7000) -> tuple[DataFrame, DataFrame]:
    """(summary rows in per cent, one JSON text per chosen question). ``answers``: id, run, set_name, output, correct, method."""
    runs = [base, *tuned, *([dpo] if dpo else [])]
    wide = evaluation.common_questions(answers, runs, "set_name")
    kind = evaluation.bucket(F.col(f"`{base}`"), [F.col(f"`{t}`") for t in tuned], F.col(f"`{dpo}`") if dpo else None)
    chosen = evaluation.first_of_bucket(wide.select("set_name", "id", kind.alias("bucket")), per_bucket, "set_name").select("id", "bucket", "set_name")
    shown = evaluation.replay(chosen, samples, answers.where(F.col("run").isin(runs)), most)
    tallies = evaluation.tally(answers, "run", "set_name")
    percent = [F.round(F.col(c) * 100, 1).alias(c) for c in ("acc", "ci_low", "ci_high", "abstain_rate")]
    return tallies.select("run", "set_name", "n", *percent), shown.select("id", "set_name", "bucket", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("question_json"))


def load_report(summary: DataFrame, before: str, after: str) -> str:
    """Markdown of load-test levels (label, concurrency, figures) and the gain between two series."""
    rows = summary.orderBy("label", "concurrency").collect()  # one row per level
    gate(bool(rows), "no load-test level")

    def shown(v: float | None, digits: int) -> str:
        return "—" if v is None else f"{v:.{digits}f}"

    lines = ["| series | concurrency | TTFT p50 / p95 ms | TPOT p50 ms | tok/s | req/s | failed |", "|---|---|---|---|---|---|---|"]
    lines += [f"| {r['label']} | {r['concurrency']} | {shown(r['ttft_p50'], 1)} / {shown(r['ttft_p95'], 1)} | {shown(r['tpot_p50'], 1)} | {shown(r['output_tok_s'], 1)} | {shown(r['req_per_s'], 3)} | {r['failed']} |" for r in rows]
    gain = loadtest.gain(summary, before, after).first()
    if gain["gain"] is not None:
        lines += ["", f"Peak {gain['peak_before']:.1f} to {gain['peak_after']:.1f} tok/s ({gain['gain']:+.0f} %)."]
    return "\n".join(lines) + "\n"
