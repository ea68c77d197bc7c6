"""Answers of an external chat service, asked from the executors.

The service is a function made once per partition by ``make_client``; it takes a prompt and the
number of answers and returns a list of texts. One request that fails costs its row a null and an
error text, not the job; rows without answer are asked again by the next resumed run. The number of
partitions bounds the open requests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuloom.functions.extract import judge_reply
from corpuloom.sources.adapters import render_question
from corpuloom.streaming.resume import bounded

Client = Callable[[str, int], list[str]]


def prompts(samples: DataFrame, choice: str, open_: str) -> DataFrame:
    """id, prompt: the rendered question in the template of its kind (one ``{}`` each)."""

    def filled(template: str) -> Column:
        before, _, after = template.partition("{}")
        return F.concat(F.lit(before), render_question(F.col("question"), F.col("options")), F.lit(after))

    return samples.select("id", F.when(F.col("options").isNotNull(), filled(choice)).otherwise(filled(open_)).alias("prompt"))


def complete(asked: DataFrame, make_client: Callable[[], Client], n: int = 1, at_once: int = 16) -> DataFrame:
    """id, solutions (null where the request failed), error of (id, prompt)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            out: list[tuple] = []
            for key, prompt in zip(frame["id"], frame["prompt"]):
                try:
                    out.append((key, list(client(prompt, n)), None))
                except Exception as e:
                    out.append((key, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["id", "solutions", "error"])

    return bounded(asked.select("id", "prompt"), at_once).mapInPandas(run, "id string, solutions array<string>, error string")


def judged(asked: DataFrame, make_client: Callable[[], Client], template: str, at_once: int = 8) -> DataFrame:
    """id, correct of (id, question, gold, output); null where the judge's reply is no verdict. Template fields: {question} {gold} {output}."""
    parts = F.lit(template)
    for name in ("question", "gold", "output"):
        parts = F.replace(parts, F.lit("{" + name + "}"), F.coalesce(F.col(name), F.lit("")))
    replies = complete(asked.select("id", parts.alias("prompt")), make_client, 1, at_once)
    return replies.select("id", judge_reply(F.get("solutions", F.lit(0))).alias("correct"))
