"""Text expressions that several operators share. All are JVM-side columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ---------------------------------------------------------------
#: Characters that trimming removes: everything up to the blank.
TRIMMED = r"[\x00-\x20]"
#: White space that matching ignores.
BLANKS = r"[ \t\n\x0b\f\r]+"
#: Headings: Markdown, chapters, numbers, Chinese numbers, Chinese numbers in brackets.
HEADING = (
    r"^(#{1,6}[ \t\n\x0b\f\r]+.+"
    r"|第[一二三四五六七八九十百千万0-9]{1,12}[章节篇部卷].*"
    r"|[0-9]{1,3}([.．、]|\))[ \t\n\x0b\f\r]*.+"
    r"|[一二三四五六七八九十百千万]{1,6}[、.．）)][ \t\n\x0b\f\r]*.+"
    r"|（[一二三四五六七八九十百千万]{1,6}）[ \t\n\x0b\f\r]*.+)$"
)
# --------------------------------------------------------------------------------


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where `use` refers to it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_all(text: Column) -> Column:
    """Without leading and trailing control characters and blanks."""
    return F.regexp_replace(text, f"^{TRIMMED}+|{TRIMMED}+$", "")


def clean(text: Column) -> Column:
    """Unix line ends, single blanks, at most one empty line in a row, trimmed."""
    lines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return trim_all(F.regexp_replace(F.regexp_replace(lines, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def squash(text: Column) -> Column:
    """Lower case without any white space: the form in which terms are matched."""
    return F.regexp_replace(F.lower(text), BLANKS, "")


def is_heading(line: Column) -> Column:
    """Whether a trimmed line is a heading."""
    return line.rlike(HEADING)


def first_line(text: Column) -> Column:
    """The trimmed first line."""
    return trim_all(F.substring_index(text, "\n", 1))


def first_filled_line(text: Column) -> Column:
    """The first line that isn't blank, else the empty string."""
    return F.regexp_extract(text, r"(?m)^[^\S\n\r]*(\S[^\n\r]*)", 1)


def without_words(text: Column, words: list[str]) -> Column:
    """Delete the words one after the other, in the given order."""
    for w in words:
        text = F.replace(text, F.lit(w), F.lit(""))
    return text


def has_cjk(text: Column) -> Column:
    """Whether a Chinese character (U+4E00 to U+9FA5) occurs."""
    return text.rlike("[一-龥]")


def occurrences(text: Column, term: Column) -> Column:
    """How often a term occurs without overlaps; 0 for an empty term."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, (gone / F.length(term)).cast("bigint")).otherwise(F.lit(0))
