"""Column expressions on text that follow Python's string semantics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that is neither letter nor digit of any script.
NOT_WORD = r"[^\p{L}\p{N}]+"
_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used (a lambda binds it)."""
    return F.get(F.transform(F.array(value), use), 0)


def norm_text(c: Column) -> Column:
    """Lower-cased letters and digits of a text; null stays null."""
    return F.lower(F.regexp_replace(c, NOT_WORD, ""))


def py_strip(c: Column) -> Column:
    """Unicode white space, file separators included, off both ends."""
    return F.regexp_replace(c, _STRIP, "")


def shingles(normalised: Column, n: int) -> Column:
    """Distinct stretches of ``n`` characters; a shorter text is its own one, an empty text has none.

    One look-ahead per position finds overlapping stretches in linear time.
    """
    pattern = F.lit(f"(?s)(?=(.{{{n}}}))")

    def of(t: Column) -> Column:
        grams = F.array_distinct(F.regexp_extract_all(t, pattern, F.lit(1)))
        return F.when(F.length(t) >= n, grams).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))

    return let(normalised, of)


def sorted_letters(c: Column) -> Column:
    """Distinct characters of a text in code-point order, joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(c, ""))), "")


def first_clause(c: Column) -> Column:
    """The part before the first clause mark."""
    return F.split(c, "[,。;!?]", 2).getItem(0)


def last(array: Column) -> Column:
    """Last element of an array, null when it has none."""
    return F.try_element_at(array, F.lit(-1))


def filled(c: Column) -> Column:
    """The text, null where it is empty."""
    return let(c, lambda t: F.when(t != "", t))
