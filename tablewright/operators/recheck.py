"""The approved rules evaluated a second time, from decision tables written as SQL text.

Validation compares a stored candidate with what this module makes of the original. It shares only
fixed values (word lists, character sets) with the rules, none of their functions: a fault in one of
them, or a change of it, shows as a difference. Custom rules have no second form and are run as they are.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.columns import IDENTITY, ROW_ID, data_columns, present, quoted, type_of
from tablewright.functions import constants as K
from tablewright.functions.dates import default_pivot_year
from tablewright.functions.text import as_text, java_regex, java_replacement
from tablewright.plans.plan import Plan
from tablewright.plans.rules import CUSTOM, WITHOUT_PARAMETERS, Rule

_VALUE = "_recheck_value"
# Longer lists of replacements are a table or an array, because a CASE of them does not compile well.
MOST_CASES = 100


def text_literal(value: str) -> str:
    """A SQL literal of any text, whatever the session takes for an escape."""
    return f"decode(unhex('{value.encode().hex()}'), 'UTF-8')"


def pattern(regex: str) -> str:
    return text_literal(regex)


_SPACE = f"[{K.WHITESPACE_CLASS}]"


def _stripped(value: str) -> str:
    ends = pattern(rf"^{_SPACE}+|{_SPACE}+\z")
    return f"regexp_replace({value}, {ends}, '')"


def _texts(values: Sequence[str]) -> str:
    return "array(" + ", ".join(map(text_literal, values)) + ")"


_DIGITS = r"(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?"
_BOUNDLESS = "array('inf', 'infinity', '+inf', '+infinity', '-inf', '-infinity')"


def _plain_number(value: str, finite_only: bool) -> str:
    """CASE over plainly written numbers; written digits must not overflow if ``finite_only``."""
    number = f"try_cast({value} AS DOUBLE)"
    if finite_only:
        number = f"CASE WHEN abs({number}) < double('infinity') THEN {number} END"
    signs = f"CASE WHEN {value} LIKE '-%' THEN double('-infinity') ELSE double('infinity') END"
    plain = pattern(rf"^[+-]?{_DIGITS}\z")
    return f"CASE WHEN {value} RLIKE {plain} THEN {number} WHEN array_contains({_BOUNDLESS}, lower({value})) AND {value} RLIKE '^[ -~]+$' THEN {signs} END"


def _title(value: str) -> str:
    """Character runs by their place: the first letter after none in capital form, the others lowered."""
    cased = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]"
    runs = f"regexp_extract_all({value}, {pattern(f'{cased}+|[^{cased[1:]}+')}, 0)"
    first = "upper(left(r, 1))"
    one = f"left({first}, 1) || lower(substring({first}, 2) || substring(r, 2))"
    return f"CASE WHEN {value} IS NOT NULL THEN concat_ws('', transform({runs}, r -> {one})) END"


def _junk(extra_patterns: Sequence[str] | None = None, convert_text_zeros: bool = False) -> list[str]:
    zeros = f" OR {{v}} RLIKE {pattern(r'^0+$')}" if convert_text_zeros else ""
    extras = [p for p in extra_patterns or [] if p.strip(K.WHITESPACE)]
    listed = f" OR array_contains({_texts(extras)}, {{v}})" if extras else ""
    found = f"array_contains({_texts(K.JUNK_TOKENS)}, lower({{v}})){listed}{zeros}"
    return [_stripped("{c}"), f"CASE WHEN {{c}} IS NULL OR {found} THEN NULL ELSE {{c}} END"]


def _replaced(mappings: Sequence[dict]) -> list[str]:
    """First mapping that finds its text decides."""
    cases = []
    for mapping in mappings:
        find, new, mode = mapping["find"], mapping.get("replace"), mapping.get("match", "exact")
        if mode == "regex":
            found = pattern(java_regex(find))
            hit, out = f"{{c}} RLIKE {found}", None if new is None else f"regexp_replace({{c}}, {found}, {text_literal(java_replacement(new))})"
        elif mode == "contains":
            hit = f"instr({{c}}, {text_literal(find)}) > 0"
            out = None if new is None else f"array_join(split({{c}}, {pattern(_literal_pattern(find))}, -1), {text_literal(new)})"
        else:
            hit, out = f"{{v}} = {text_literal(find)}", None if new is None else text_literal(new)
        cases.append(f"WHEN {hit} THEN {out or 'NULL'}")
    return [_stripped("{c}"), "CASE " + " ".join(cases) + " ELSE {c} END"] if cases else ["{c}"]


def _literal_pattern(text: str) -> str:
    return "".join(f"\\x{{{ord(ch):x}}}" for ch in text)


def _numbers(
    locale: str = "auto", remove_currency: bool = True, handle_parentheses_negatives: bool = True, convert_percentages: bool = False
) -> list[str]:
    """Amounts step by step. The value is a struct: what is left of the text, sign and divisor."""
    inner = pattern(r"(?s)^\((.*)\)\z")
    steps = [f"named_struct('t', {_stripped('{c}')}, 'sign', 1.0D, 'by', 1.0D)"]
    if handle_parentheses_negatives:
        steps.append(
            f"named_struct('t', CASE WHEN {{v}}.t RLIKE {inner} THEN {_stripped(f'regexp_extract({{v}}.t, {inner}, 1)')} ELSE {{v}}.t END, "
            f"'sign', CASE WHEN {{v}}.t RLIKE {inner} THEN -1.0D ELSE 1.0D END, 'by', 1.0D)"
        )

    def changed(text: str, by: str = "{v}.by") -> str:
        return f"named_struct('t', {text}, 'sign', {{v}}.sign, 'by', {by})"

    if remove_currency:
        bare = "{v}.t"
        for mark in (*K.CURRENCY_CODES, *K.CURRENCY_SYMBOLS):
            bare = f"replace({bare}, {text_literal(mark)}, '')"
        steps.append(changed(bare))
        steps.append(changed(_stripped("{v}.t")))
    steps.append(changed("replace({v}.t, ' ', '')"))
    if convert_percentages:
        share = "right({v}.t, 1) = '%'"
        cut = _stripped("left({v}.t, length({v}.t) - 1)")
        steps.append(changed(f"CASE WHEN {share} THEN {cut} ELSE {_stripped('{v}.t')} END", f"CASE WHEN {share} THEN 100.0D ELSE 1.0D END"))
    last_dot, last_comma = "locate('.', reverse({v}.t))", "locate(',', reverse({v}.t))"
    without_commas = "replace({v}.t, ',', '')"
    comma_for_point = "replace(replace({v}.t, '.', ''), ',', '.')"
    only_comma_for_point = "replace({v}.t, ',', '.')"
    if locale == "us":
        steps.append(changed(without_commas))
    elif locale == "eu":
        ending = pattern(r",\p{Nd}+$")
        steps.append(changed(f"CASE WHEN {{v}}.t RLIKE {ending} THEN {comma_for_point} ELSE {only_comma_for_point} END"))
    elif locale == "auto":
        identifier = pattern(rf"^[+-]*(?:0[0-9]+|[0-9]{{{K.IDENTIFIER_DIGITS},}})$")
        thousands = pattern(r",\p{Nd}{3}$")
        steps.append(changed(
            f"CASE WHEN {last_dot} = 0 AND {last_comma} = 0 THEN CASE WHEN NOT {{v}}.t RLIKE {identifier} THEN {{v}}.t END "
            f"WHEN {last_dot} > 0 AND {last_comma} > 0 THEN CASE WHEN {last_comma} < {last_dot} THEN {comma_for_point} ELSE {without_commas} END "
            f"WHEN {last_dot} = 0 AND {{v}}.t RLIKE {thousands} THEN {without_commas} ELSE {only_comma_for_point} END"
        ))
    # Digits of other scripts are read by the database function that knows their values.
    steps.append(changed(_stripped("{v}.t")))
    steps.append(changed(f"CASE WHEN {{v}}.t RLIKE '[^ -~]' THEN {_ascii_digits('{v}.t')} ELSE {{v}}.t END"))
    grouped = pattern("(?<=[0-9])_(?=[0-9])")
    steps.append(changed(f"regexp_replace({{v}}.t, {grouped}, '')"))
    return [*steps, f"({_plain_number('{v}.t', False)}) * {{v}}.sign / {{v}}.by"]


def _ascii_digits(value: str) -> str:
    """Digits by the place of their character in its block of ten."""
    cases = []
    for code in range(0x80, sys.maxunicode + 1):
        if unicodedata.digit(chr(code), None) == 0 and unicodedata.category(chr(code)) == "Nd":
            cases.append(f"WHEN ascii(x) BETWEEN {code} AND {code + 9} THEN chr({48} + ascii(x) - {code})")
    return f"array_join(transform(split({value}, ''), x -> CASE {' '.join(cases)} ELSE x END), '')"


def _dates(dayfirst: bool = True, pivot_year: int | None = None, allow_time: bool = False) -> list[str]:
    """Written forms as (pattern, year, month, day, other order too); the first that is a date counts."""
    pivot = pivot_year or default_pivot_year()
    clock = pattern(r"[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?(?: ?[AaPp][Mm])?$")
    first, second = (2, 1) if dayfirst else (1, 2)
    century = f"CASE WHEN int('20' || right({{v}}, 2)) >= {pivot} THEN '19' ELSE '20' END || right({{v}}, 2)"
    forms = [
        (r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\z", 1, 2, 3, False),
        (r"^([0-9]{4})[/.]([0-9]{1,2})[/.]([0-9]{1,2})\z", 1, 2, 3, dayfirst),
        (r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{4})\z", 3, first, second, True),
        (r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{2})\z", century, first, second, True),
        (r"^([0-9]{4})([0-9]{2})([0-9]{2})\z", 1, 2, 3, False),
        (r"^([0-9]{1,2})[/\-]([0-9]{4})\z", 2, 1, "'01'", False),
    ]
    if allow_time:
        forms.append((r"^([0-9]{4})\z", 1, "'01'", "'01'", False))
    names = "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in K.MONTHS)
    months = "array(" + ", ".join(f"'{m[:3]}'" for m in K.MONTHS) + ")"
    cases = []

    def made(regex: str, year, month, day) -> str:
        part = lambda x: f"regexp_extract({{v}}, {pattern(regex)}, {x})" if isinstance(x, int) else x
        return f"try_cast(concat_ws('-', {part(year)}, {part(month)}, {part(day)}) AS DATE)"

    for regex, year, month, day, both in forms:
        values = [made(regex, year, month, day)] + ([made(regex, year, day, month)] if both else [])
        cases.append(f"WHEN {{v}} RLIKE {pattern(regex)} THEN coalesce({', '.join(values)})")
    for regex, month, day, year in (
        (rf"(?i)^([0-9]{{1,2}})[ /\-]({names})[ /\-]([0-9]{{4}})\z", 2, 1, 3), (rf"(?i)^({names}) ([0-9]{{1,2}}),? ([0-9]{{4}})\z", 1, 2, 3)
    ):
        named = f"string(array_position({months}, lower(left(regexp_extract({{v}}, {pattern(regex)}, {month}), 3))))"
        cases.append(f"WHEN {{v}} RLIKE {pattern(regex)} THEN {made(regex, year, named, day)}")
    found = f"date_format(CASE {' '.join(cases)} END, 'yyyy-MM-dd')"
    if not allow_time:
        leading, exact = pattern(r"^[0-9]{4}(?:-[^/]*)?$"), pattern(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$")
        found = f"CASE WHEN NOT {{c}} RLIKE {leading} OR {{c}} RLIKE {exact} THEN {found} END"
    return [f"regexp_replace({_stripped('{c}')}, {clock}, '')", found]


def _cell_steps(rule: Rule, data_type: T.DataType) -> list[str] | None:
    """SQL texts, each on the cell ``{c}`` and the value ``{v}`` of the one before; null for no effect."""
    parameters = {} if rule.action in WITHOUT_PARAMETERS else dict(rule.parameters)
    if rule.action == "normalize_dates" and isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return ["date_format({c}, 'yyyy-MM-dd')"]
    if not isinstance(data_type, T.StringType):
        if rule.action == "normalize_dates":
            return ["string({c})", *_dates(**parameters)]
        if rule.action == "normalize_numbers":
            return ["CASE WHEN NOT isnan(double({c})) THEN double({c}) END"]
        return None
    blank = pattern(rf"^{_SPACE}*\z")
    if rule.action == "normalize_case":
        form = parameters.get("format", "upper")
        return [_title("{c}") if form == "title" else "lower({c})" if form == "lower" else "upper({c})"]
    if rule.action == "strip_invisibles":
        gone = pattern(f"[{K.INVISIBLE_CHARS}]")
        return [f"regexp_replace({{c}}, {pattern(K.LINE_BREAK_RUN)}, ' ')", f"regexp_replace({{v}}, {gone}, '')"]
    return {
        "trim_text": lambda: [_stripped("{c}")],
        "blank_to_null": lambda: [f"CASE WHEN NOT {{c}} RLIKE {blank} THEN {{c}} END"],
        "to_numeric_strict": lambda: [_stripped("{c}"), _plain_number("{v}", True)],
        "junk_to_null": lambda: _junk(**parameters),
        "replace_values": lambda: _replaced(**parameters),
        "normalize_numbers": lambda: _numbers(**parameters),
        "normalize_dates": lambda: _dates(**parameters),
    }[rule.action]()


def _replaced_by_table(df: DataFrame, name: str, mappings: Sequence[dict]) -> DataFrame:
    """Long lists: whole cells are found by a join with the list, parts by a search of the array of finds.

    The list comes with the rule and is on the driver already; Spark broadcasts it if it is small.
    The search tries every find on every cell, which is slow but shares nothing with the automaton.
    """
    spark, whole, parts, places = df.sparkSession, {}, {}, []
    for place, mapping in enumerate(mappings):
        find, mode = mapping["find"], mapping.get("match", "exact")
        if mode == "regex":
            found = pattern(java_regex(find))
            new = mapping.get("replace")
            out = "NULL" if new is None else f"regexp_replace({{c}}, {found}, {text_literal(java_replacement(new))})"
            places.append((place, found, out))
        else:
            (parts if mode == "contains" else whole).setdefault(find, (place, mapping.get("replace")))
    cell, names = quoted(name), [quoted(n) for n in df.columns]
    table = spark.createDataFrame([(f, *v) for f, v in whole.items()], "_find string, _place int, _new string")
    df = df.selectExpr(*names, f"{_stripped(cell)} AS {_VALUE}").join(table, F.expr(f"{_VALUE} = _find"), "left")
    finds = json.dumps([{"f": f, "p": p, "r": r} for f, (p, r) in sorted(parts.items(), key=lambda item: item[1][0])])
    array = f"from_json({text_literal(finds)}, 'array<struct<f:string,p:int,r:string>>')"
    df = df.selectExpr(*names, "_place", "_new", f"get(filter({array}, m -> instr({cell}, m.f) > 0), 0) AS _part")
    least = "least(_place, _part.p)"
    cases = [
        f"WHEN coalesce({least} > {place}, true) AND {cell} RLIKE {found} THEN {out.replace('{c}', cell)}"
        for place, found, out in places
    ]
    cases += [
        f"WHEN {least} = _place THEN _new",
        f"WHEN {least} = _part.p THEN replace({cell}, _part.f, _part.r)",
    ]
    return df.selectExpr(*(f"CASE {' '.join(cases)} ELSE {cell} END AS {n}" if n == cell else n for n in names))


def _cell(df: DataFrame, rule: Rule) -> DataFrame:
    """One projection per step, so that no text of a step is repeated in the next one."""
    if rule.action == "replace_values" and len(rule.parameters["mappings"]) > MOST_CASES:
        return _replaced_by_table(df, rule.column, rule.parameters["mappings"])
    if rule.action == "custom":
        return df.withColumn(rule.column, CUSTOM[rule.parameters["name"]](F.col(quoted(rule.column))))
    steps = _cell_steps(rule, type_of(df, rule.column))
    if not steps:
        return df
    names = df.columns
    for step in steps:
        sql = step.replace("{c}", quoted(rule.column)).replace("{v}", _VALUE)
        df = df.selectExpr(*map(quoted, names), f"{sql} AS {_VALUE}")
    return df.selectExpr(*(f"{_VALUE} AS {quoted(n)}" if n == rule.column else quoted(n) for n in names))


def _present_sql(df: DataFrame, name: str) -> str:
    real = isinstance(type_of(df, name), (T.DoubleType, T.FloatType))
    return f"({quoted(name)} IS NOT NULL" + (f" AND NOT isnan({quoted(name)}))" if real else ")")


def _first_or_last(df: DataFrame, keys: Sequence[str], last: bool, order_by: Sequence[str] | None, scope: Sequence[str]) -> DataFrame:
    """Each group's row with the least or greatest order, as a struct aggregate."""
    order = list(order_by or [ROW_ID])
    if ROW_ID not in order:
        order += [f.name for f in df.schema.fields if f.name not in (*order, *keys) and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    row, rank = (f"struct({', '.join(map(quoted, names))})" for names in (df.columns, order))
    groups = [f"{quoted(name)} AS _g{i}" for i, name in enumerate((*scope, *keys))]
    grouped = df.selectExpr(*groups, f"{row} AS r", f"{rank} AS o").groupBy(*(f"_g{i}" for i in range(len(groups))))
    return grouped.agg(F.expr(f"{'max' if last else 'min'}_by(r, o)").alias("r")).select("r.*")


def _text_sql(df: DataFrame, name: str, alias: str) -> DataFrame:
    """The text of a cell as a column of its own; texts stay, other types are written out."""
    return df.withColumn(alias, as_text(present(df, name), type_of(df, name)))


def _shape(df: DataFrame, rule: Rule) -> DataFrame:
    names, parameters = df.columns, rule.parameters
    if rule.action == "rename_column":
        return df.selectExpr(*(f"{quoted(n)} AS {quoted(parameters['new_name'] if n == rule.column else n)}" for n in names))
    if rule.action == "split_column":
        delimiter = pattern(_literal_pattern(parameters["delimiter"]))
        df = _text_sql(df, rule.column, _VALUE).selectExpr(*map(quoted, names), f"split({_VALUE}, {delimiter}, -1) AS {_VALUE}")
        parts = [f"{_stripped(f'get({_VALUE}, {i})')} AS {quoted(new)}" for i, new in enumerate(parameters["new_column_names"])]
        place = names.index(rule.column)
        return df.selectExpr(*map(quoted, names[:place]), *parts, *map(quoted, names[place + 1 :]))
    sources, new = list(parameters["source_columns"]), parameters["new_column_name"]
    for i, name in enumerate(sources):
        df = _text_sql(df, name, f"_recheck_{i}")
    between = f" || {text_literal(parameters.get('separator', ' '))} || "
    merged = between.join(f"coalesce(_recheck_{i}, '')" for i in range(len(sources))) + f" AS {quoted(new)}"
    gone = set(sources) if parameters.get("drop_source_columns") else set()
    out = []
    for name in names:
        if name == new:
            out.append(merged)
            continue
        out += [merged] if name == sources[0] and new not in names else []
        out += [] if name in gone else [quoted(name)]
    return df.selectExpr(*out)


def evaluate(plan: Plan, df: DataFrame, order_by: Sequence[str] | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """What the approved rules make of a table, rule by rule in their order."""
    for rule in plan.applied:
        if rule.action == "drop_empty_rows":
            df = df.filter(" OR ".join(_present_sql(df, name) for name in data_columns(df)))
        elif rule.action == "drop_empty_columns":
            counted = df.selectExpr(*(f"count_if({_present_sql(df, n)}) AS c{i}" for i, n in enumerate(data_columns(df)))).first()
            gone = {n for i, n in enumerate(data_columns(df)) if not counted[i]}
            df = df.selectExpr(*(quoted(n) for n in df.columns if n not in gone))
        elif rule.action == "dedupe_exact":
            names, identity = data_columns(df), [n for n in IDENTITY if n in df.columns]
            if ROW_ID in df.columns:
                keys = [n for n in (*scope, *names)]
                df = _first_or_last(df, [k for k in keys if k not in scope], False, [n for n in identity if n not in keys], scope).select(*map(quoted, df.columns))
            else:
                df = df.distinct()
        elif rule.action == "dedupe_by_key":
            keys = rule.parameters.get("subset_columns") or [rule.column]
            df = _first_or_last(df, keys, rule.parameters.get("keep", "first") == "last", order_by, scope)
        elif rule.action in ("split_column", "merge_columns", "rename_column"):
            df = _shape(df, rule)
        else:
            df = _cell(df, rule)
    return df
