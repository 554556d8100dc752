"""Text cell functions, ``Column`` to ``Column``. All are native but for long lists of replacements."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import constants as K


def strip(col: Column) -> Column:
    """Remove Unicode whitespace from both ends (``F.trim`` would remove U+0020 only)."""
    return F.btrim(col, F.lit(K.WHITESPACE))


trim_text = strip


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def blank_to_null(col: Column) -> Column:
    """Null for whitespace-only text; other values keep their outer spaces."""
    return F.when(is_blank(col), F.lit(None)).otherwise(col)


def is_junk(
    col: Column, extra_patterns: list[str] | None = None, convert_text_zeros: bool = False
) -> Column:
    """True for placeholder texts: listed tokens without case, extras exactly, zeros on request."""
    text = strip(col)
    found = F.lower(text).isin(*K.JUNK_TOKENS)
    # A blank cell is left to blank_to_null, so an extra pattern can never be blank here.
    extras = [p for p in (extra_patterns or []) if p.strip(K.WHITESPACE)]
    if extras:
        found = found | text.isin(*extras)
    if convert_text_zeros:
        found = found | text.rlike("^0+$")
    return found


def junk_to_null(
    col: Column, extra_patterns: list[str] | None = None, convert_text_zeros: bool = False
) -> Column:
    return F.when(is_junk(col, extra_patterns, convert_text_zeros), F.lit(None)).otherwise(col)


# Put before each word so that ``initcap`` starts one there; a private-use character and a space.
_MARK = "\uf8ff"
#: Characters whose change of case depends on their place or has several characters, and the mark.
_SPECIAL = "[" + _MARK + "".join(
    ch
    for ch in map(chr, (*range(0x80, 0xD800), *range(0xF900, 0x10000)))
    if len(ch.upper()) > 1 or len(ch.lower()) > 1 or ch.upper() != ch.title() or ch in "Σςσ"
) + "]"
# Letters that have a case, with those of other categories such as Roman numerals.
_CASED = r"[\p{IsUppercase}\p{IsLowercase}\p{Lt}]"


def title_case(col: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others.

    ``initcap`` only starts a word after a space and would give ``O'neil`` and ``María-josé``, so a
    mark with a space is put before each word first. Texts with special characters go run by run.
    """
    marked = F.regexp_replace(col, f"(?<!{_CASED})(?={_CASED})", f"{_MARK} ")
    plain = F.replace(F.initcap(marked), F.lit(f"{_MARK} "), F.lit(""))
    # Most characters are ASCII and none of these is special, so the long class sees few of them.
    beyond = F.regexp_replace(col, r"[\x00-\x7F]+", "")
    special = (F.octet_length(col) > F.char_length(col)) & beyond.rlike(_SPECIAL)
    return F.when(special, _title_runs(col)).otherwise(plain)


def _title_runs(col: Column) -> Column:
    runs = F.regexp_extract_all(col, F.lit(f"{_CASED}+|[^{_CASED[1:]}+"), F.lit(0))

    def titled(run: Column) -> Column:
        # One letter may have two as its capital form (ß to SS): only the first stays upper.
        capital = F.upper(F.substring(run, 1, 1))
        rest = F.concat(F.substr(capital, F.lit(2)), F.substr(run, F.lit(2)))
        return F.concat(F.substring(capital, 1, 1), F.lower(rest))

    return F.array_join(F.transform(runs, titled), "")


def normalize_case(col: Column, format: str = "upper") -> Column:
    """``upper``, ``lower`` or ``title``; any other name means ``upper``."""
    if format == "title":
        return title_case(col)
    return F.lower(col) if format == "lower" else F.upper(col)


def strip_invisibles(col: Column) -> Column:
    """Line breaks and tabs become one space per run; zero-width and no-break characters go."""
    return F.translate(F.regexp_replace(col, K.LINE_BREAK_RUN, " "), K.INVISIBLE_CHARS, "")


def neutralize_formula(col: Column) -> Column:
    """Prefix text that a spreadsheet would evaluate with an apostrophe."""
    return F.when(col.rlike(K.FORMULA_PREFIX), F.concat(F.lit("'"), col)).otherwise(col)


def java_regex(pattern: str) -> str:
    """Java spelling of a Python pattern, for the subset both engines share."""
    try:
        re.compile(pattern)
    except re.error as error:
        raise ValueError(f"invalid regular expression {pattern!r}: {error}") from error
    if re.search(r"\(\?\(", pattern):
        raise ValueError(f"conditional groups are not supported: {pattern!r}")
    java = re.sub(r"\(\?P<", "(?<", pattern)
    java = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", java)
    return re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", java)


def java_replacement(template: str) -> str:
    """Java spelling of a Python replacement template (``\\1`` and ``\\g<name>`` to ``$``)."""

    def one(match: re.Match) -> str:
        number, name, escaped, plain = match.groups()
        if number is not None:
            return f"${number}"
        if name is not None:
            return f"${name}" if name.isdigit() else f"${{{name}}}"
        if escaped is not None:
            known = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\\\"}
            return known.get(escaped, "\\\\" + re.escape(escaped))
        return "\\$" if plain == "$" else plain

    return re.sub(r"\\(\d)|\\g<(\w+)>|\\(.)|(.)", one, template, flags=re.DOTALL)


# A CASE of more branches than this no longer compiles well; longer lists are looked up instead.
MOST_BRANCHES = 100


def _first_literal(mappings: list[dict]) -> Callable[[Column, Column], Column]:
    """Struct (place, value) of the first exact or contains mapping that hits a cell, from Arrow batches.

    Exact finds are one dictionary lookup; all contains finds are met by one pass of an automaton
    over the text. Both are as large as the list in the rule. ``place`` is null where none hits.
    """
    exact: dict[str, int] = {}
    inner: dict[str, int] = {}
    for place, mapping in enumerate(mappings):
        mode = mapping.get("match", "exact")
        if mode != "regex":
            (inner if mode == "contains" else exact).setdefault(mapping["find"], place)
    new = {place: mappings[place].get("replace") for place in (*exact.values(), *inner.values())}

    @F.pandas_udf("place int, value string")
    def first(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for find, place in inner.items():
            automaton.add_word(find, (place, find))
        automaton.make_automaton()

        def hit(raw: str | None, stripped: str | None) -> tuple[int | None, str | None]:
            if raw is None:
                return None, None
            whole = exact.get(stripped, len(mappings))
            part, find = min((found for _, found in automaton.iter(raw)), default=(whole, "")) if inner else (whole, "")
            if whole <= part:
                return (whole, new[whole]) if whole < len(mappings) else (None, None)
            return part, None if new[part] is None else raw.replace(find, new[part])

        for raw, stripped in batches:
            rows = [hit(*pair) for pair in zip(raw, stripped)]
            places = pd.array([row[0] for row in rows], dtype="Int32")
            yield pd.DataFrame({"place": places, "value": pd.Series([row[1] for row in rows], dtype=object)})

    return first


def _replace_many(col: Column, mappings: list[dict]) -> Column:
    """Long lists: one lookup for all literal finds, branches for regular expressions only."""
    text = col.cast("string")
    found = _first_literal(mappings)(text, strip(text))
    chain = None
    for place, mapping in enumerate(mappings):
        if mapping.get("match", "exact") != "regex":
            continue
        pattern, new = java_regex(mapping["find"]), mapping.get("replace")
        hit = F.coalesce(found["place"] > place, F.lit(True)) & col.rlike(pattern)
        out = F.lit(None).cast("string") if new is None else F.regexp_replace(col, pattern, java_replacement(new))
        chain = F.when(hit, out) if chain is None else chain.when(hit, out)
    literal = found["place"].isNotNull()
    chain = F.when(literal, found["value"]) if chain is None else chain.when(literal, found["value"])
    return chain.otherwise(col)


def replace_values(col: Column, mappings: list[dict]) -> Column:
    """First matching mapping decides: whole cell (exact), every occurrence (contains), regex."""
    if len(mappings) > MOST_BRANCHES:
        return _replace_many(col, mappings)
    chain = None
    for mapping in mappings:
        find, new = mapping["find"], mapping.get("replace")
        mode = mapping.get("match", "exact")
        null = F.lit(None).cast("string")
        if mode == "exact":
            hit = strip(col) == find
            out = null if new is None else F.lit(new)
        elif mode == "contains":
            hit = F.contains(col, F.lit(find))
            out = null if new is None else F.replace(col, F.lit(find), F.lit(new))
        else:
            pattern = java_regex(find)
            hit = col.rlike(pattern)
            out = null if new is None else F.regexp_replace(col, pattern, java_replacement(new))
        chain = F.when(hit, out) if chain is None else chain.when(hit, out)
    return col if chain is None else chain.otherwise(col)


def split_part(col: Column, delimiter: str, index: int) -> Column:
    """Part ``index`` of the text split on a literal delimiter, stripped; null if missing."""
    return strip(F.get(split_parts(col, delimiter), F.lit(index)))


def split_parts(col: Column, delimiter: str) -> Column:
    quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.split(col.cast("string"), quoted, -1)


def as_text(col: Column, data_type: T.DataType) -> Column:
    """Text of a cell: ``True``/``False`` for booleans, plain decimals for doubles."""
    if isinstance(data_type, T.StringType):
        return col
    if isinstance(data_type, T.BooleanType):
        return F.initcap(col.cast("string"))
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return _double_text(col)
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(col)
    if isinstance(data_type, T.BinaryType):
        return F.hex(col)
    return col.cast("string")


def _double_text(col: Column) -> Column:
    raw = col.cast("string")
    size = F.abs(col)
    # Plain notation: digits come from the shortest text, so no binary noise is added.
    plain = F.regexp_replace(
        F.regexp_replace(raw.try_cast(T.DecimalType(38, 22)).cast("string"), "0+$", ""), r"\.$", ".0"
    )
    exponent = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(raw, r"\.0E", "E"), "E-?(?=\\d)", "e+"), "^$", ""
    )
    negative = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(raw, r"\.0E", "E"), r"E-(\d)$", "e-0$1"), "E-", "e-"
    )
    return (
        F.when((size >= 1e-3) & (size < 1e7), raw)
        .when(size == 0, raw)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .when((size >= 1e16) & (size < float("inf")), exponent)
        .when(size < 1e-4, negative)
        .when(F.isnan(col), F.lit("nan"))
        .when(col > 0, F.lit("inf"))
        .when(col < 0, F.lit("-inf"))
    )


def merge_texts(parts: list[Column], separator: str) -> Column:
    """Join text parts; a null contributes an empty part (``concat_ws`` would skip it)."""
    return F.array_join(F.array(*parts), separator, "")


def digit_count(col: Column) -> Column:
    return F.length(F.regexp_replace(col, r"\P{Nd}", ""))
