"""Date cell functions: written date forms are rewritten to year-month-day and cast once."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions import constants as K
from tablewright.functions.text import strip

_TIME_SUFFIX = r"[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?(?: ?[AaPp][Mm])?$"
# Every known form starts like this; other texts skip the patterns.
_POSSIBLE = r"^(?:[0-9]|(?i:" + "|".join(sorted({m[:3] for m in K.MONTHS})) + r"))[^\n]*[0-9]"

_MONTH = "(?i:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in K.MONTHS) + ")"
# The look-ahead checks the whole name, the group keeps its first three letters.
_MONTH_GROUP = rf"(?={_MONTH}[ /\-])([A-Za-z]{{3}})[A-Za-z]*"

_ISO = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
_LEADING_YEAR = r"^[0-9]{4}(?:-[^/]*)?$"
_YEAR_THEN_PARTS = r"^([0-9]{4})[/.]([0-9]{1,2})[/.]([0-9]{1,2})$"
_PARTS_THEN_YEAR = r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{4})$"
_PARTS_THEN_SHORT_YEAR = r"^([0-9]{{1,2}})[/.\-]([0-9]{{1,2}})[/.\-]({years})$"
_COMPACT = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"
_MONTH_YEAR = r"^([0-9]{1,2})[/\-]([0-9]{4})$"
_DAY_MONTH_NAME = rf"^([0-9]{{1,2}})[ /\-]{_MONTH_GROUP}[ /\-]([0-9]{{4}})$"
_MONTH_NAME_DAY = rf"^{_MONTH_GROUP} ([0-9]{{1,2}}),? ([0-9]{{4}})$"


def default_pivot_year() -> int:
    """First year that a two-digit year cannot mean; stored in the rule so it can be replayed."""
    return date.today().year + 50


def date_text(col: Column) -> Column:
    """First step: the stripped text without a time of day."""
    return F.regexp_replace(strip(col), _TIME_SUFFIX, "")


def year_first(text: Column, dayfirst: bool, pivot: int, allow_time: bool = False) -> Column:
    """Second step: numeric forms as year, month, day; '-' if that order is certain, '/' if not."""
    last_century = "|".join(f"{y % 100:02d}" for y in range(pivot, 2100)) or "(?!)"
    short = "$1/$2/"
    for pattern, new in (
        (_YEAR_THEN_PARTS, "$1/$2/$3" if dayfirst else "$1-$2-$3"),
        (_PARTS_THEN_SHORT_YEAR.format(years=last_century), short + "19$3"),
        (_PARTS_THEN_SHORT_YEAR.format(years="[0-9]{2}"), short + "20$3"),
        (_PARTS_THEN_YEAR, "$3/$2/$1" if dayfirst else "$3/$1/$2"),
        (_COMPACT, "$1-$2-$3"),
        (_MONTH_YEAR, "$2-$1-01"),
    ):
        text = F.regexp_replace(text, pattern, new)
    return F.regexp_replace(text, "^([0-9]{4})$", "$1-01-01") if allow_time else text


def _cast(text: Column) -> Column:
    # Null instead of an empty text, because a cast that fails costs an exception.
    return F.nullif(F.regexp_extract(text, _ISO, 0), F.lit("")).try_cast("date")


def date_value(raw: Column, text: Column, ordered: Column, allow_time: bool = False) -> Column:
    """Last step: the DATE, from the raw cell and the results of the two steps before."""
    swapped = F.regexp_replace(ordered, "^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})$", "$1-$3-$2")
    named = F.regexp_replace(
        F.regexp_replace(text, _MONTH_NAME_DAY, "$2-$1-$3"), _DAY_MONTH_NAME, "$1-$2-$3"
    )
    named = F.regexp_extract(named, "^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$", 0)
    found = F.when(text.rlike("[A-Za-z]{3}"), F.try_to_date(F.nullif(named, F.lit("")), "d-MMM-yyyy")).otherwise(
        F.coalesce(_cast(F.translate(ordered, "/", "-")), _cast(swapped))
    )
    # Most text of a non-date column ends here, before any of the patterns above.
    possible = text.rlike(_POSSIBLE)
    if not allow_time:
        possible = possible & (~raw.rlike(_LEADING_YEAR) | raw.rlike(_ISO))
    return F.when(possible, found)


def parse_date(
    col: Column,
    dayfirst: bool = True,
    pivot_year: int | None = None,
    allow_time: bool = False,
) -> Column:
    """DATE of a text in one of the known forms, else null.

    A text that starts with a four-digit year and holds no '/' must be exactly year-month-day,
    unless ``allow_time`` also admits outer spaces, a time of day and a year alone. Forms with
    two leading numbers take day first or month first, and the other order if that is no date.
    """
    text = date_text(col)
    ordered = year_first(text, dayfirst, pivot_year or default_pivot_year(), allow_time)
    return date_value(col, text, ordered, allow_time)


def normalize_dates(
    col: Column,
    dayfirst: bool = True,
    pivot_year: int | None = None,
    allow_time: bool = False,
) -> Column:
    """``yyyy-MM-dd`` text of :func:`parse_date`, null where the text is no known date."""
    return F.date_format(parse_date(col, dayfirst, pivot_year, allow_time), "yyyy-MM-dd")
