"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.functions.text import matches, pad_left

# What stands in for an absent event date or year.
NO_EVENT_DATE = "9999-12-31"
NO_EVENT_YEAR = 2021

# Where year, month and day sit in the two birth date layouts.
BIRTH_LAYOUTS = {
    "Gebdat": {"year": (7, 4), "month": (4, 2), "day": (1, 2)},
    "Geburtsdatum": {"year": (1, 4), "month": (6, 2), "day": (9, 2)},
}


def parse_dmy(c: Column) -> Column:
    """ddmmyyyy, also when the leading zero was lost; anything else is missing."""
    return F.try_to_date(pad_left(c, 8), "ddMMyyyy")


def parse_ymd(c: Column) -> Column:
    return F.try_to_date(c, "yyyy-MM-dd")


def parse_columns(df: DataFrame, names: list[str], parse=parse_ymd) -> DataFrame:
    return df.withColumns({n: parse(F.col(n)) for n in names})


def split_ddmmyyyy(attr: Column, value: Column) -> dict[str, Column]:
    """Year, month and day text for date attributes, blank for all others."""
    is_date = matches(attr, "Date")
    year = F.when(is_date, F.regexp_replace(value, ".*(....)$", "$1")).otherwise("")
    rest = pad_left(F.regexp_replace(value, "(.*)....$", "$1"), 4)
    blank = F.lit("")
    return {
        "year": year,
        "month": F.when(year != "", F.substring(rest, 3, 2)).when(year == "", blank),
        "day": F.when(year != "", F.substring(rest, 1, 2)).when(year == "", blank),
    }


def date_parts_by_schema(df: DataFrame) -> DataFrame:
    """Year, month and day text from whichever birth date column the table has."""
    name = next((n for n in BIRTH_LAYOUTS if n in df.columns), None)
    if name is None:
        raise ValueError(f"expected one of {list(BIRTH_LAYOUTS)}")
    return df.withColumns({part: F.substring(F.col(name), start, length)
                           for part, (start, length) in BIRTH_LAYOUTS[name].items()})


def add_months(c: Column, months: int, strict: bool = False) -> Column:
    """Month arithmetic; a day that does not exist is clamped, or missing when ``strict``."""
    moved = F.add_months(c, months)
    return F.when(F.dayofmonth(moved) == F.dayofmonth(c), moved) if strict else moved


def decade_text(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 3), F.lit("0"))


def decade_floor(c: Column) -> Column:
    return F.floor(c / 10) * 10


def age_in_centuries(birth: Column, as_of: Column) -> Column:
    return F.floor(F.datediff(as_of, birth) / 365) / 100


def onset_age(diagnosis_year: Column, birth: Column) -> Column:
    return diagnosis_year.try_cast("double") - F.year(birth)


def quarter_text(c: Column) -> Column:
    return F.quarter(c).cast("string")


def date_or_sentinel(c: Column) -> Column:
    return F.coalesce(parse_ymd(c), F.lit(NO_EVENT_DATE).cast("date"))


def before_event(date: Column, event: Column) -> Column:
    """Records before the event; all records where there is none."""
    return event.isNull() | (date < event)
