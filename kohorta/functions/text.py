"""Text cleaning expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters left by a wrong code page and the letters they stand for.
STRAY_CHARACTERS = "\u0081\u0084"
STRAY_LETTERS = "üä"

# What counts as a plain number in a text cell, and as a plain zero.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
ZERO_PATTERN = r"^\s*[+-]?(0+\.?0*|\.0+)([eE][+-]?[0-9]+)?\s*$"

# Edits that turn a measurement name into a key: letters for letters (or none), then a pattern, then letters again.
KEY_BLANKS, KEY_UNITS, KEY_LETTERS = (" ", "_"), "_.37°.|_absolut", ("ö°", "?")

# Text results of the ordinal measurement family.
ORDINAL_CODES = {"negativ": "0", "positiv": "1", "stark positiv": "2"}


def pad_left(c: Column, width: int, fill: str = "0") -> Column:
    """Left-pad; unlike ``lpad`` a longer text is never cut."""
    return F.when(F.length(c) < width, F.lpad(c, width, fill)).otherwise(c)


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def strip_title(c: Column, title: str = "Dr. ") -> Column:
    return F.regexp_replace(c, f"{title}(.*)", "$1")


def repair_encoding(c: Column) -> Column:
    return F.translate(c, STRAY_CHARACTERS, STRAY_LETTERS)


def matches(c: Column, pattern: str) -> Column:
    """Regex test in which a missing text does not match."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def regex_flag(c: Column, pattern: str) -> Column:
    return matches(c, pattern).cast("int")


def any_regex(c: Column, patterns: Sequence[str], literal: bool = False) -> Column:
    """Case-insensitive match with any of a list; an empty list matches nothing."""
    kept = [re.escape(p) if literal else p for p in patterns if p]
    if not kept:
        return F.lit(False)
    return matches(c, "(?i)" + "|".join(f"({p})" for p in kept))


def normalize_key(c: Column) -> Column:
    """Single characters are translated: the optimizer repeats this expression in filters and joins, and an expression that is
    a chain of patterns then costs more than reading the row."""
    return F.translate(F.regexp_replace(F.translate(c, *KEY_BLANKS), KEY_UNITS, ""), *KEY_LETTERS)


def is_number(c: Column) -> Column:
    return matches(c, NUMBER_PATTERN)


def is_zero(c: Column) -> Column:
    return matches(c, ZERO_PATTERN)


def to_number(c: Column) -> Column:
    return F.when(is_number(c), c.try_cast("double"))


def decimal_comma(c: Column) -> Column:
    """Number from text with a decimal comma or point; anything else is missing."""
    return to_number(F.translate(c, ",", "."))


def ordinal_code(key: Column, value: Column, family: str = "Titin") -> Column:
    """Code the text results of one key family; its other texts become blank."""
    coded = F.when(value.isin(*ORDINAL_CODES), F.element_at(
        F.create_map(*[F.lit(x) for pair in ORDINAL_CODES.items() for x in pair]), value)).otherwise(F.lit(""))
    return F.when(matches(key, family), coded).otherwise(value)


def concat_path(a: Column, b: Column) -> Column:
    return F.concat_ws(", ", a, b)


def split_term(c: Column, separator: str, count: int, prefix: str = "part") -> list[Column]:
    """Up to ``count`` parts; missing parts are null."""
    parts = F.split(c, re.escape(separator))
    return [F.get(parts, F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(count)]
