"""Number cell functions: strict parsing and locale-aware normalisation."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions import constants as K
from tablewright.functions.text import is_blank, strip

# Spark's cast also reads '12d', '1f' and '0x1.0p3', so text is filtered before it.
_FINITE = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_INFINITE = r"[+-]?(?i:inf|infinity)"

_OTHER_DIGITS = "".join(
    chr(code)
    for code in range(0x80, sys.maxunicode + 1)
    if unicodedata.category(chr(code)) == "Nd"
)
_OTHER_DIGIT_VALUES = "".join(str(unicodedata.digit(ch)) for ch in _OTHER_DIGITS)


def _matched(col: Column, pattern: str) -> Column:
    """The text itself if it matches as a whole, else null.

    Null and not the empty text, whose cast would raise and catch an exception for every row.
    """
    return F.regexp_substr(col, F.lit(f"^(?:{pattern})$"))


def parse_strict(col: Column) -> Column:
    """Double of a plainly written number, null for everything else (also for overflow)."""
    text = strip(col)
    number = _matched(text, _FINITE).try_cast("double")
    infinite = F.when(text.rlike(f"^{_INFINITE}$"), text.try_cast("double"))
    return F.coalesce(F.nullif(F.nullif(number, F.lit(float("inf"))), F.lit(float("-inf"))), infinite)


def is_lossy(col: Column) -> Column:
    """True where a strict conversion would destroy a non-blank value."""
    return col.isNotNull() & ~is_blank(col) & parse_strict(col).isNull()


def guard_strict(col: Column, parsed: Column, name: str = "value") -> Column:
    """The parsed number; a text that it does not stand for fails the job and is named in the error."""
    message = F.concat(
        F.lit(f"strict conversion of column '{name}' would lose the value '"), col, F.lit("'")
    )
    lost = parsed.isNull() & col.isNotNull() & ~is_blank(col)
    return F.when(lost, F.raise_error(message).cast("double")).otherwise(parsed)


def to_numeric_strict(col: Column, name: str = "value") -> Column:
    """Strict double in one expression; a plan parses first and guards the result in a second step."""
    return guard_strict(col, parse_strict(col), name)


def parse_float(col: Column) -> Column:
    """Double of a stripped text: digits of any script and '_' between digits are allowed."""
    ascii_digits = F.when(
        col.rlike(r"[^\x00-\x7f]"), F.translate(col, _OTHER_DIGITS, _OTHER_DIGIT_VALUES)
    ).otherwise(col)
    joined = F.regexp_replace(ascii_digits, "(?<=[0-9])_(?=[0-9])", "")
    return _matched(joined, f"{_FINITE}|{_INFINITE}").try_cast("double")


def _resolve_separators(text: Column, locale: str) -> Column:
    """Text with at most one '.' as decimal mark; null where the identifier guard applies."""
    no_commas = F.translate(text, ",", "")
    comma_decimal = F.translate(text, ",.", ".")
    if locale == "us":
        return no_commas
    if locale == "eu":
        return (
            F.when(text.rlike(r",\p{Nd}+$"), comma_decimal)
            .otherwise(F.translate(text, ",", "."))
        )
    if locale != "auto":
        return text
    identifier = rf"^[+-]*(?:0[0-9]+|[0-9]{{{K.IDENTIFIER_DIGITS},}})$"
    return (
        F.when(~text.rlike("[.,]"), F.when(~text.rlike(identifier), text))
        # Both marks: the last one is the decimal mark.
        .when(text.rlike(r"(?s)\..*,[^.]*$"), comma_decimal)
        .when(text.rlike(r"(?s),.*\.[^,]*$"), no_commas)
        # Commas only: a last group of exactly three digits means thousands.
        .when(text.rlike(r"(?s)^[^.]*,\p{Nd}{3}$"), no_commas)
        .otherwise(F.translate(text, ",", "."))
    )


_WRAPPED = r"(?s)^\((.*)\)$"


def number_text(
    col: Column, remove_currency: bool = True, handle_parentheses_negatives: bool = True
) -> Column:
    """First step: the text without accounting parentheses, currency marks and spaces."""
    text = strip(col)
    if handle_parentheses_negatives:
        text = strip(F.regexp_replace(text, _WRAPPED, "$1"))
    if remove_currency:
        for mark in (*K.CURRENCY_CODES, *K.CURRENCY_SYMBOLS):
            text = F.replace(text, F.lit(mark), F.lit(""))
        text = strip(text)
    return F.replace(text, F.lit(" "), F.lit(""))


def number_value(
    raw: Column,
    text: Column,
    locale: str = "auto",
    handle_parentheses_negatives: bool = True,
    convert_percentages: bool | Column = False,
) -> Column:
    """Last step: the double, from the raw cell and the text of the first step."""
    sign, divisor = F.lit(1.0), F.lit(1.0)
    if handle_parentheses_negatives:
        sign = F.when(strip(raw).rlike(_WRAPPED), F.lit(-1.0)).otherwise(sign)
    if convert_percentages is not False:
        wanted = F.lit(True) if convert_percentages is True else convert_percentages
        divisor = F.when(wanted & text.endswith("%"), F.lit(100.0)).otherwise(divisor)
        text = strip(F.regexp_replace(text, F.when(wanted, r"%\z").otherwise("(?!)"), F.lit("")))
    # Python's float() ignores outer whitespace, hence the last strip.
    return parse_float(strip(_resolve_separators(text, locale))) * sign / divisor


def normalize_numbers(
    col: Column,
    locale: str = "auto",
    remove_currency: bool = True,
    handle_parentheses_negatives: bool = True,
    convert_percentages: bool | Column = False,
) -> Column:
    """Locale-aware double of a money-like text, null where it cannot be read.

    ``convert_percentages`` may be a boolean column where each row decides for itself.
    """
    text = number_text(col, remove_currency, handle_parentheses_negatives)
    return number_value(col, text, locale, handle_parentheses_negatives, convert_percentages)


def probe_text(col: Column) -> Column:
    """Rough plain form used only to decide whether a column looks like amounts."""
    text = F.regexp_replace(
        strip(col), rf"USD|EUR|GBP|U\$S|US\$|[$€£{K.WHITESPACE_CLASS}]", ""
    )
    text = F.regexp_replace(F.regexp_replace(text, r"^\((.+)\)$", "$1"), "%+$", "")
    identifier = rf"^\+?(?:\p{{Nd}}{{{K.IDENTIFIER_DIGITS},}})$|^0\p{{Nd}}+$"
    # An identifier is blanked, so that it is no number below.
    return F.translate(F.regexp_replace(text, identifier, ""), ",.", ".")


def is_number(col: Column) -> Column:
    """Whether a text is a plainly written number, without parsing it."""
    return col.rlike(f"^(?:{_FINITE}|{_INFINITE})$")
