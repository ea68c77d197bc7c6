"""Final answers of model outputs, and other readings of answer texts, as column expressions.

The patterns are fixed values: they decide which texts declare an answer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuloom.functions.text import filled, last, let, py_strip, sorted_letters

#: Only the end of an output is read.
TAIL = 2000
WRAPPER = r"\\(?:text|mathrm|mathbf)\{([^{}]*)\}"
LETTER = r"[A-J](?![A-Za-z0-9一-鿿])"
BOXED_LETTERS = r"\\boxed\{((?=[^{}]*[A-Ja-j])[A-Ja-j\s、,和]+)\}"
DECLARED_LETTERS = rf"(?:最终答案|正确答案|答案|(?<![不别勿莫误错])故选|(?<![不别勿莫误错])应选)\s*(?:是|为|:)?\s*[*\s「【\[(]*({LETTER}(?:\s*[、,和\s]\s*{LETTER})*)"
ENGLISH_LETTER = r"(?i:the\s+answer\s+is|answer\s*:)\s*[*\s]*\(?([A-Ja-j])\)?(?![A-Za-z0-9])"
CHOICE = f"(?U){BOXED_LETTERS}|{DECLARED_LETTERS}|{ENGLISH_LETTER}"
#: The wide reading: full-width colons and commas count, and letters may run together.
WIDE_RUN = r"[A-J]+(?:\s*[、,，和\s]\s*[A-J]+)*(?![A-Za-z0-9一-鿿])"
WIDE_CHOICE = rf"(?U){BOXED_LETTERS}|(?:最终答案|正确答案|答案|(?<![不别勿莫误错])故选|(?<![不别勿莫误错])应选)\s*(?:是|为|[:：])?\s*[*\s「【\[(（]*({WIDE_RUN})|{ENGLISH_LETTER}"
BOXED_TEXT = r"\\boxed\{([^{}]+)\}"
DECLARED_TEXT = r"(?Ud)(?:最终答案|答案)\s*(?:是|为|:)\s*(.+)"
CLOSING = r"[。.」】]+\z"
THINK, END_THINK = "<think>", "</think>"
OMITTED = "\n\n……（中段省略）……\n\n"


def _tail(output: Column) -> Column:
    return F.regexp_replace(F.right(output, F.lit(TAIL)), WRAPPER, "$1")


def extract_choice(output: Column, wide: bool = False) -> Column:
    """Letters of the last declaration: upper case, distinct, sorted; null where none is declared.

    ``wide`` also reads full-width punctuation and letters that run together.

    One alternation searches for all declarations in one pass, so that the last one is the last of
    the array; its letters are read from the short match.
    """
    pattern = WIDE_CHOICE if wide else CHOICE
    declared = last(F.regexp_extract_all(_tail(output), F.lit(pattern), F.lit(0)))
    letters = let(declared, lambda d: F.concat(*(F.regexp_extract(d, pattern, g) for g in (1, 2, 3))))
    return filled(sorted_letters(F.upper(F.regexp_replace(letters, "[^A-Ja-j]", ""))))


#: The first declaration as a reader's page shows it; full-width colons and commas count here.
FIRST_LETTERS = r"(?:最终答案|正确答案|答案)\s*(?:是|为|[:：])?\s*([A-J](?:\s*[、,，和\s]\s*[A-J])*)(?![A-Za-z0-9])"
FIRST_ENGLISH = r"(?i)(?:the answer is|answer\s*:)\s*\(?([A-J])\)?"


def first_declared(conclusion: Column) -> Column:
    """Letters of the first declaration, as written; for display only."""
    letters = F.regexp_replace(F.regexp_extract(conclusion, f"(?U){FIRST_LETTERS}", 1), r"(?U)[\s、,，和]", "")
    return F.coalesce(filled(letters), filled(F.upper(F.regexp_extract(conclusion, FIRST_ENGLISH, 1))))


def extract_text(output: Column) -> Column:
    """Last boxed text, else the last answer line; null where none is declared."""
    tail = _tail(output)
    boxed = py_strip(last(F.regexp_extract_all(tail, F.lit(BOXED_TEXT), F.lit(1))))
    line = py_strip(last(F.regexp_extract_all(tail, F.lit(DECLARED_TEXT), F.lit(1))))
    return filled(F.regexp_replace(F.coalesce(boxed, line), CLOSING, ""))


def extract(output: Column, is_choice: Column) -> Column:
    return F.when(is_choice, extract_choice(output)).otherwise(extract_text(output))


def split_thinking(output: Column) -> tuple[Column, Column]:
    """(thinking, conclusion): parted at the last closing tag; without one all is conclusion."""
    has = output.contains(END_THINK)
    parts = r"(?s)\A(.*)</think>(.*)\z"
    before = F.regexp_replace(F.regexp_extract(output, parts, 1), r"\A<think>", "")
    return F.when(has, py_strip(before)).otherwise(F.when(output.isNotNull(), F.lit(""))), F.when(has, py_strip(F.regexp_extract(output, parts, 2))).otherwise(py_strip(output))


def keep_ends(text: Column, most: int) -> Column:
    """A text longer than ``most`` characters without its middle."""
    half = most // 2
    return let(text, lambda t: F.when(F.length(t) > most, F.concat(F.left(t, F.lit(half)), F.lit(OMITTED), F.right(t, F.lit(half)))).otherwise(t))


def judge_reply(reply: Column) -> Column:
    """``correct`` of the JSON object in a judge's reply; null unless it is a boolean."""
    return F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "correct boolean")["correct"]
