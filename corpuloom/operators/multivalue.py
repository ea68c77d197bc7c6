"""Several values packed in one field: one row per value, with its position.

The field is split on quote characters. Odd pieces are quoted literals, kept together whatever they
contain; even pieces are split on delimiters, but never inside one of the row's own option texts.
Array folds put the pieces of all kinds together in the order written. A value is an option letter
(upper case, half width; letters are separate values even when quoted together or run together) or
a text equal to one of the row's options.

Everything is a column expression; rows never leave the JVM, nothing is shuffled but keys of
found values. Defined results: null, blank and meaningless fields give no values; introductory words
and closing punctuation are no values; empty pieces are not counted; repeated values are kept; rows
with fewer than two values do not come out; options that are null or not readable leave letters
only; rows delivered twice (same key) count once; rows with a null key are kept once per position. Empty
tables give no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuloom.functions.text import let, py_strip

#: Words before an answer, quotes of any kind, delimiters.
INTRODUCTION = r"(?i)^\s*(?:(?:最终|正确|参考|标准)?答案(?:是|为)?|本题选|应选|故选|选|(?:the\s+)?(?:correct\s+)?answers?(?:\s+(?:is|are))?)\s*[:：]?\s*"
QUOTE, DOUBLED = "\u0002", "\u0001"
FULL_WIDTH = "".join(map(chr, [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]))
HALF_WIDTH = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2
DELIMITERS = ",，、;；|/&+·\\n\\r\\t"
BETWEEN_LETTERS = r"[\s,，、;；|/&+·.．。:：\-－和及与\u0002()（）\[\]【】]"
LETTERS = rf"^{BETWEEN_LETTERS}*[A-Ja-j](?:{BETWEEN_LETTERS}*[A-Ja-j])*{BETWEEN_LETTERS}*$"


def option_texts(options: Column) -> Column:
    """Trimmed texts of a JSON list of {key, value} or of a JSON object; empty where there are none."""
    listed = F.transform(F.from_json(options, "array<struct<key:string,value:string>>"), lambda o: o["value"])
    mapped = F.map_values(F.from_json(options, "map<string,string>"))
    texts = F.when(F.ltrim(options).startswith("["), listed).when(F.ltrim(options).startswith("{"), mapped)
    return F.coalesce(F.array_distinct(F.filter(F.transform(texts, py_strip), lambda t: F.length(t) > 0)), F.array().cast("array<string>"))


def _marked(answer: Column) -> Column:
    """The field without introduction, with one kind of quote, doubled quotes set aside, letters unwrapped."""
    a = F.regexp_replace(py_strip(answer), INTRODUCTION, "")
    a = F.regexp_replace(a, r'^\[\s*(?=["“])|(?<=["”])\s*\]$', "")  # brackets of a list of strings
    a = F.regexp_replace(a, r'(?<=[^\s,，、;；|\[])""(?=[^\s,，、;；|\]])', DOUBLED)
    a = F.regexp_replace(a, r"[\"“”„‟「」『』＂]", QUOTE)
    a = F.regexp_replace(a, rf"(?<=^|[\s{DELIMITERS}])['‘’]|['‘’](?=$|[\s{DELIMITERS}。.])", QUOTE)
    return F.regexp_replace(a, r"[(（\[【]\s*([A-Ja-jＡ-Ｊａ-ｊ])\s*[)）\]】]", " $1 ")


def _letters(piece: Column) -> Column:
    return F.regexp_extract_all(F.upper(piece), F.lit("[A-J]"), F.lit(0))


def values(answer: Column, options: Column) -> Column:
    """array<string> of the values of a field, in the order written. ``options``: the row's option texts."""
    found = let(_marked(answer), lambda marked: _values(py_strip(answer), marked, options))
    return F.coalesce(found, F.array().cast("array<string>"))


def _values(answer: Column, marked: Column, options: Column) -> Column:
    half = F.translate(marked, FULL_WIDTH, HALF_WIDTH)

    def known(t: Column) -> Column:
        return F.array_contains(options, t)

    def values_of(piece: Column) -> Column:
        def read(clean: Column) -> Column:
            folded = F.translate(clean, FULL_WIDTH, HALF_WIDTH)
            return F.when(known(clean), F.array(clean)).when(folded.rlike(LETTERS), _letters(folded)).otherwise(F.array().cast("array<string>"))

        return let(py_strip(F.regexp_replace(F.replace(piece, F.lit(DOUBLED), F.lit('"')), r"[。．.]+\s*$", "")), read)

    # an even piece is cut at delimiters, but the row's own texts (the longest first) stay whole; only where one of them
    # has a delimiter, or something else may stand behind it, does that take a pattern of the row's own
    longest_first = F.array_sort(options, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    quoted = F.transform(longest_first, lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    plain = rf"[^\s{DELIMITERS}][^{DELIMITERS}]*"
    own = F.concat(F.lit("(?:"), F.array_join(quoted, "|"), F.lit(rf")(?=\s*(?:[{DELIMITERS}和。.]|$))|{plain}"))
    special = (F.size(options) > 0) & (marked.rlike("[和。.]") | F.exists(options, lambda t: t.rlike(f"[{DELIMITERS}]")))

    def cut(cutter: Column) -> Column:
        return F.transform(F.split(marked, QUOTE), lambda p, i: F.when(i % 2 == 1, F.array(p)).otherwise(F.regexp_extract_all(F.replace(p, F.lit(DOUBLED), F.lit('""')), cutter, F.lit(0))))

    pieces = F.when(special, let(own, cut)).otherwise(cut(F.lit(plain)))
    folded = F.flatten(F.transform(F.flatten(pieces), values_of))
    # a field of nothing but letters, quoted or not
    return F.when(known(answer), F.array(answer)).when(half.rlike(LETTERS), _letters(half)).otherwise(folded)


def explode_values(rows: DataFrame, key: str = "row_no", answer: str = "answer", options: str = "options", least: int = 2) -> DataFrame:
    """``key``, ``pos`` (from 1), ``value``: the values of every field with at least ``least`` of them."""
    texts = rows.select(key, F.col(answer).alias("__answer"), option_texts(F.col(options)).alias("__options"))
    found = texts.select(key, values(F.col("__answer"), F.col("__options")).alias("__values")).where(F.size("__values") >= least)
    each = found.select(key, F.posexplode("__values").alias("pos", "value"))
    return each.select(key, (F.col("pos") + 1).alias("pos"), "value").dropDuplicates([key, "pos"])
