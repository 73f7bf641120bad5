"""String features of chunks and the small text shapes used in results and evaluation sets."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that mark code, mathematics and lists in a chunk (case-sensitive).
CODE_MARKERS = ["```", "def ", "function", "class ", "import "]
MATH_MARKERS = ["=", "+", "-", "*", "/", "equation", "formula"]
LIST_MARKERS = ["•", "1.", "2.", "- ", "* "]
# Fixed value: a chunk with more pipes than this counts as a table.
TABLE_PIPES = 4


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words, Unicode whitespace included."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long")


def char_count(text: Column) -> Column:
    return F.length(text).cast("long")


def sentence_count(text: Column) -> Column:
    """Number of full stops, exclamation marks and question marks."""
    return F.regexp_count(text, F.lit("[.!?]")).cast("long")


def contains_any(text: Column, markers: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(m)) for m in markers])


def has_code(text: Column) -> Column:
    return contains_any(text, CODE_MARKERS)


def has_math(text: Column) -> Column:
    return contains_any(text, MATH_MARKERS)


def has_list(text: Column) -> Column:
    return contains_any(text, LIST_MARKERS)


def has_table(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))) > TABLE_PIPES


def position_label(index: Column, total: Column) -> Column:
    """Where a chunk stands in its document: the first, one of the last two, or between."""
    return (
        F.when(index == 0, F.lit("beginning")).when(index >= total - 2, F.lit("end")).otherwise(F.lit("middle"))
    )


def section_label(index: Column) -> Column:
    """Only the opening chunk has a section type that follows from its place."""
    return F.when(index == 0, F.lit("introduction"))


def truncate(text: Column, limit: int) -> Column:
    """Cut to `limit` characters and mark the cut; shorter text is returned unchanged."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)


def preview(text: Column, limit: int = 200) -> Column:
    """The first characters followed by dots, whether or not anything was cut."""
    return F.concat(F.substring(text, 1, limit), F.lit("..."))


def keyword_query_text(text: Column, min_line: int = 20, words: int = 10) -> Column:
    """First words of the first line that is long enough, or of the whole text when no line is."""
    lines = F.filter(
        F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", "")),
        lambda line: F.length(line) > min_line,
    )
    source = F.coalesce(F.try_element_at(lines, F.lit(1)), text)
    return F.array_join(F.slice(F.regexp_extract_all(source, F.lit(r"(?U)\S+"), F.lit(0)), 1, words), " ")


def title_label(label: Column) -> Column:
    """`user_only` becomes `User Only`."""
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def config_label(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
