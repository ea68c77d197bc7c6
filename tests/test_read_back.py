"""Every key is read back from known forms, compared with a plain reading of the same texts."""

import os
import re

import pytest

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")

from corpuloom.plans.queries import QUERIES  # noqa: E402


def keys(spark, which):
    return {r["id"]: r["gold"] for r in spark.read.parquet(f"{DATA}/samples.parquet").where(which).where("id is not null").collect()}


def test_whole_letter_lists(spark):
    gold = keys(spark, "options is not null and gold <> ''")
    got = {r["id"]: (r["declaration"], r["correct"]) for r in QUERIES["extract_choice_whole"](spark, DATA).collect()}
    assert any(len(g) > 1 for g in gold.values())
    assert got == {i: (None, None) if ord(i[-1]) % 4 == 3 else ("".join(sorted(set(g))), True) for i, g in gold.items()}


def test_all_open_keys(spark):
    gold = keys(spark, "options is null and gold is not null")
    got = {r["id"]: r for r in QUERIES["extract_text_whole"](spark, DATA).collect()}
    assert got.keys() == gold.keys() and any(g.endswith("。") for g in gold.values()) and any(len(g) >= 60 for g in gold.values())
    for i, r in got.items():
        tail = r["output"][-2000:]
        boxed, line = re.findall(r"\\boxed\{([^{}]+)\}", tail), re.findall(r"(?:最终答案|答案)\s*(?:是|为|:)\s*(.+)", tail)
        want = re.sub(r"[。.」】]+\Z", "", (boxed or line or [""])[-1].strip()) or None
        assert r["declaration"] == want, i
        if want is not None and "\n" not in gold[i] and not re.search(r"[{}]", gold[i]) and re.search(r"\w", gold[i]) and len(gold[i]) < 1900:
            assert r["correct"] is True, i
