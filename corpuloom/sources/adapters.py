"""Adapters from raw rows of each source family to the canonical sample, with quarantine.

Every adapter takes a DataFrame with ``ord`` (the raw row number, from which ids are made, so that
dropped rows leave gaps) and returns ``(samples, quarantine)``. Missing columns fail fast; bad
values (an answer that is empty or names no option) put the row into quarantine with the reason.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpuloom.functions.text import let, py_strip, sorted_letters
from corpuloom.sources.readers import SAMPLE, require

OPTION_COLUMNS = ("A", "B", "C", "D", "E")
SEPARATORS = r"[\s,，、;/]+"

Adapted = tuple[DataFrame, DataFrame]


@dataclass(frozen=True)
class Source:
    adapter: str
    split: str


#: Sources by name: adapter and split (train, val, test).
SOURCES = {
    "med-o1-verifiable": Source("med-o1-verifiable", "train"),
    "med-o1-sft-zh": Source("med-o1-sft-zh", "train"),
    "med-r1-zh": Source("med-r1-zh", "train"),
    "cmexam-test": Source("cmexam", "test"),
    "cmexam-val": Source("cmexam", "val"),
    "cmb-val": Source("cmb-val", "val"),
    "medxpertqa": Source("medxpertqa", "test"),
}


def entries_to_map(entries: Column) -> Column:
    """Map of (key, value) entries, trimmed; of equal keys the last one wins, null values are kept."""
    trimmed = F.transform(F.filter(entries, lambda e: e["key"].isNotNull()), lambda e: F.struct(py_strip(e["key"]).alias("key"), py_strip(e["value"]).alias("value")))

    def last_of_each(rows: Column) -> Column:
        # an entry stays if its key does not come again behind it
        return let(F.transform(rows, lambda e: e["key"]), lambda keys: F.filter(rows, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"])))

    return F.map_from_entries(let(trimmed, last_of_each))


def json_options(c: Column) -> Column:
    """Option map of a JSON list of {key, value} or a JSON object, told apart by the first character."""
    head = F.ltrim(c)
    listed = entries_to_map(F.from_json(c, "array<struct<key:string,value:string>>"))
    mapped = entries_to_map(F.map_entries(F.from_json(c, "map<string,string>", {"mapKeyDedupPolicy": "LAST_WIN"})))
    return F.when(head.startswith("["), listed).when(head.startswith("{"), mapped)


def clean_gold(c: Column, separators: bool) -> Column:
    """Answer letters: upper case, distinct, sorted; optionally without separators between them."""
    up = F.upper(c)
    return sorted_letters(F.regexp_replace(up, SEPARATORS, "") if separators else py_strip(up))


def valid_gold(gold: Column, options: Column) -> Column:
    """Whether the answer has letters and all of them are option keys."""
    named = let(F.map_keys(options), lambda keys: F.forall(F.split(gold, ""), lambda c: F.array_contains(keys, c)))
    return F.coalesce((gold != "") & named, F.lit(False))


def _samples(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    empty = {"options": F.lit(None).cast("map<string,string>"), "cot": F.lit(None).cast("string"), "meta": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))}
    made = {"id": F.concat(F.lit(f"{source}-"), F.col("ord").cast("string")), "source": F.lit(source), **empty, **columns}
    return df.select("ord", *(made[f.name].cast(f.dataType).alias(f.name) for f in SAMPLE))


def _parted(adapted: DataFrame, ok: Column, reason: str, answer: Column) -> Adapted:
    good = adapted.where(ok).drop("__raw")
    bad = adapted.where(~ok).select("ord", "source", F.lit(reason).alias("reason"), answer.alias("detail"))
    return good, bad


def _open(df: DataFrame, source: str, question: str, gold: str, cot: str | None = None) -> Adapted:
    require(df, "ord", question, gold, *([cot] if cot else []))
    q, g = F.col(f"`{question}`"), F.col(f"`{gold}`")
    extra = {"cot": py_strip(F.col(f"`{cot}`"))} if cot else {}
    out = _samples(df, source, question=py_strip(q), gold=py_strip(g), **extra)
    return _parted(out, F.col("question").isNotNull() & F.col("gold").isNotNull(), "null text", F.coalesce("question", F.lit("")))


def verifiable(df: DataFrame, source: str = "med-o1-verifiable") -> Adapted:
    return _open(df, source, "Open-ended Verifiable Question", "Ground-True Answer")


def reasoning(df: DataFrame, source: str = "med-o1-sft-zh") -> Adapted:
    return _open(df, source, "Question", "Response", "Complex_CoT")


def distilled(df: DataFrame, source: str = "med-r1-zh") -> Adapted:
    return _open(df, source, "question", "response (content)", "reasoning (reasoning_content)")


def _choice(df: DataFrame, source: str, question: Column, options: Column, answer: Column, separators: bool, meta: Column | None = None) -> Adapted:
    rows = df.select("ord", question.alias("__q"), options.alias("__o"), answer.alias("__a"), *([meta.alias("__m")] if meta is not None else []))
    extra = {"meta": F.col("__m")} if meta is not None else {}
    gold = F.coalesce(clean_gold(F.col("__a"), separators), F.lit(""))
    out = _samples(rows.withColumn("__g", gold), source, question=py_strip(F.col("__q")), gold=F.col("__g"), options=F.col("__o"), **extra)
    ok = valid_gold(F.col("gold"), F.col("options")) & F.col("question").isNotNull()
    return _parted(out, ok, "answer is no option", F.col("gold"))


def cmexam(df: DataFrame, source: str = "cmexam-test") -> Adapted:
    """Options as JSON text, as list of {key, value}, as map, or in columns A to E."""
    require(df, "ord", "Question", "Answer")
    if "Options" in df.columns:
        kind = df.schema["Options"].dataType.typeName()
        c = F.col("Options")
        if kind == "string":
            options = json_options(c)
        elif kind == "array":
            options = entries_to_map(c)
        elif kind == "map":
            options = entries_to_map(F.map_entries(c))
        else:
            raise TypeError(f"options of unknown type {kind}")
    elif {"A", "B"} <= set(df.columns):
        pairs = [F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in OPTION_COLUMNS if k in df.columns]
        options = entries_to_map(F.filter(F.array(*pairs), lambda e: F.coalesce(e["value"], F.lit("")) != ""))
    else:
        raise KeyError(f"no option columns; there are {sorted(df.columns)[:20]}")
    return _choice(df, source, F.col("Question"), options, F.col("Answer"), True)


def _meta(df: DataFrame, *names: str) -> Column:
    return F.create_map(*(x for n in names for x in (F.lit(n), F.coalesce(F.col(n), F.lit("")) if n in df.columns else F.lit(""))))


def cmb(df: DataFrame, source: str = "cmb-val") -> Adapted:
    """Option map without blank values."""
    require(df, "ord", "question", "option", "answer")
    options = F.map_filter(entries_to_map(F.map_entries("option")), lambda k, v: F.coalesce(v, F.lit("")) != "")
    return _choice(df, source, F.col("question"), options, F.col("answer"), False, _meta(df, "exam_subject", "question_type"))


def medxpertqa(df: DataFrame, source: str = "medxpertqa") -> Adapted:
    """Option map of up to ten keys, blank values kept."""
    require(df, "ord", "question", "options", "label")
    return _choice(df, source, F.col("question"), entries_to_map(F.map_entries("options")), F.col("label"), False, _meta(df, "medical_task", "body_system"))


ADAPTERS: dict[str, Callable[[DataFrame, str], Adapted]] = {
    "med-o1-verifiable": verifiable, "med-o1-sft-zh": reasoning, "med-r1-zh": distilled, "cmexam": cmexam, "cmb-val": cmb, "medxpertqa": medxpertqa,
}


def adapt(df: DataFrame, name: str) -> Adapted:
    """The samples and the quarantine of a registered source."""
    if name not in SOURCES:
        raise KeyError(f"unknown source {name}; known are {sorted(SOURCES)}")
    return ADAPTERS[SOURCES[name].adapter](df, name)


def drop_counts(quarantine: DataFrame) -> DataFrame:
    return quarantine.groupBy("source").agg(F.count(F.lit(1)).alias("dropped"))


def first_dropped(quarantine: DataFrame, k: int = 3) -> DataFrame:
    """The first k dropped rows of each source, for reports."""
    order = W.partitionBy("source").orderBy("ord")
    return quarantine.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def by_source(pool: DataFrame, source: str) -> DataFrame:
    return pool.where(F.col("source") == source)


def render_question(question: Column, options: Column) -> Column:
    """Question with its options, one per line, by key; without options the question alone."""
    lines = F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(F.lit("\n"), e["key"], F.lit(". "), F.coalesce(e["value"], F.lit(""))))
    return F.when(F.coalesce(F.size(options), F.lit(0)) > 0, F.concat(question, F.array_join(lines, ""))).otherwise(question)
