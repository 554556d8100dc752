"""Cleaning rules: driver-side plan metadata with validated constructors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import Column

from tablewright.columns import RESERVED
from tablewright.functions.dates import default_pivot_year
from tablewright.functions.text import java_regex

CELL_ACTIONS = (
    "trim_text",
    "blank_to_null",
    "junk_to_null",
    "to_numeric_strict",
    "normalize_case",
    "normalize_dates",
    "normalize_numbers",
    "replace_values",
    "strip_invisibles",
    "custom",
)
SHAPE_ACTIONS = ("split_column", "merge_columns", "rename_column")
ROW_ACTIONS = ("drop_empty_rows", "dedupe_exact", "dedupe_by_key")
TABLE_ACTIONS = ("drop_empty_rows", "drop_empty_columns", "dedupe_exact", "merge_columns")
ACTIONS = (*CELL_ACTIONS, *SHAPE_ACTIONS, *ROW_ACTIONS, "drop_empty_columns", "flag_for_review")
WITHOUT_PARAMETERS = (
    "drop_empty_rows",
    "drop_empty_columns",
    "dedupe_exact",
    "trim_text",
    "blank_to_null",
    "to_numeric_strict",
    "strip_invisibles",
    "flag_for_review",
)
# Actions that may null a value; their losses are counted.
LOSSY_ACTIONS = ("junk_to_null", "normalize_dates", "normalize_numbers", "replace_values")


class RuleError(ValueError):
    """A rule is invalid, or applying it would destroy data."""


#: Functions of custom rules by name; a plan holds the name, so that a replay finds the same function.
CUSTOM: dict[str, Callable[[Column], Column]] = {}


def register_custom(name: str, function: Callable[[Column], Column]) -> None:
    """Make a deterministic ``Column`` to ``Column`` function known to plans under a name."""
    if name in CUSTOM and CUSTOM[name] is not function:
        raise RuleError(f"a custom rule named '{name}' exists already")
    CUSTOM[name] = function


@dataclass(frozen=True)
class Rule:
    action: str
    column: str | None = None
    parameters: dict[str, Any] = field(default_factory=dict, hash=False)
    description: str = ""
    approved: bool = False
    source: str = "user"

    def approve(self, approved: bool = True) -> Rule:
        return replace(self, approved=approved)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def parameters_json(self) -> str:
        return json.dumps(self.parameters, ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Rule:
        return cls(**data)


def _names(value: Any, what: str) -> list[str]:
    if isinstance(value, str):
        value = [part.strip() for part in value.split(",")]
    names = [name for name in (value or []) if not isinstance(name, str) or name]
    if not names or not all(isinstance(name, str) for name in names):
        raise RuleError(f"{what} must be a list of column names")
    return names


def problems(rule: Rule, columns: Iterable[str] | None = None) -> list[str]:
    """What is wrong with a rule by itself and, if columns are given, on that table."""
    found: list[str] = []
    known = None if columns is None else list(columns)
    parameters = rule.parameters
    if rule.action not in ACTIONS:
        return [f"unknown action '{rule.action}'"]
    if not isinstance(parameters, dict):
        return [f"{rule.action}: parameters must be an object"]
    if rule.action not in (*TABLE_ACTIONS, "flag_for_review"):
        if not rule.column:
            return [f"{rule.action} needs a column"]
        if known is not None and rule.column not in known:
            return [f"{rule.action}: column '{rule.column}' does not exist"]

    def strings(key: str) -> bool:
        value = parameters.get(key)
        return isinstance(value, list) and bool(value) and all(isinstance(v, str) and v for v in value)

    def absent(names: list[str]) -> list[str]:
        return [] if known is None else [name for name in names if name not in known]

    if rule.action == "junk_to_null" and parameters.get("extra_patterns") is not None:
        if parameters["extra_patterns"] != [] and not strings("extra_patterns"):
            found.append("junk_to_null: extra_patterns must be a list of non-empty strings")
    elif rule.action == "dedupe_by_key":
        keys = parameters.get("subset_columns") or [rule.column]
        if not isinstance(keys, list) or absent(keys):
            found.append(f"dedupe_by_key: missing key columns {keys}")
        if parameters.get("keep", "first") not in ("first", "last"):
            found.append(f"dedupe_by_key: keep must be first or last, not {parameters['keep']!r}")
    elif rule.action == "split_column":
        delimiter = parameters.get("delimiter")
        if not isinstance(delimiter, str) or not delimiter:
            found.append("split_column: a non-empty delimiter is required")
        if not strings("new_column_names"):
            found.append("split_column: new_column_names must be a list of non-empty names")
        else:
            names = parameters["new_column_names"]
            if len(set(names)) != len(names):
                found.append("split_column: new_column_names holds duplicates")
            clash = [n for n in names if known is not None and n in known and n != rule.column]
            if clash:
                found.append(f"split_column: columns already exist: {clash}")
    elif rule.action == "merge_columns":
        name = parameters.get("new_column_name")
        if not strings("source_columns"):
            found.append("merge_columns: source_columns must be a list of columns")
        elif absent(parameters["source_columns"]):
            found.append(f"merge_columns: missing columns {absent(parameters['source_columns'])}")
        if not isinstance(name, str) or not name:
            found.append("merge_columns: new_column_name is required")
        elif known is not None and name in known and name not in (parameters.get("source_columns") or []):
            found.append(f"merge_columns: column '{name}' already exists")
        if not isinstance(parameters.get("separator", " "), str):
            found.append("merge_columns: separator must be text")
    elif rule.action == "rename_column":
        name = parameters.get("new_name")
        if not isinstance(name, str) or not name or name in RESERVED:
            found.append("rename_column: new_name must be a name that is not reserved")
        elif known is not None and name != rule.column and name in known:
            found.append(f"rename_column: column '{name}' already exists")
    elif rule.action == "custom":
        if parameters.get("name") not in CUSTOM:
            found.append(f"custom: no function is registered as {parameters.get('name')!r}")
    elif rule.action == "replace_values":
        found.extend(_mapping_problems(parameters.get("mappings")))
    return found


def _mapping_problems(mappings: Any) -> list[str]:
    if not isinstance(mappings, list) or not mappings or not all(isinstance(m, dict) for m in mappings):
        return ["replace_values: mappings must be a list of find/replace/match objects"]
    found = []
    for mapping in mappings:
        find, new, mode = mapping.get("find"), mapping.get("replace"), mapping.get("match", "exact")
        if not isinstance(find, str) or not find:
            found.append("replace_values: find must be non-empty text")
        elif mode not in ("exact", "contains", "regex"):
            found.append(f"replace_values: unknown match mode {mode!r}")
        elif new is not None and not isinstance(new, str):
            found.append("replace_values: replace must be text or null")
        elif mode == "regex":
            try:
                java_regex(find)
            except ValueError as error:
                found.append(f"replace_values: {error}")
    return found


def check(rule: Rule, columns: Iterable[str] | None = None) -> Rule:
    found = problems(rule, columns)
    if found:
        raise RuleError("; ".join(found))
    return rule


def _rule(action: str, column: str | None, description: str, **parameters: Any) -> Rule:
    return check(Rule(action, column, parameters, description))


def rename_column(column: str, new_name: str) -> Rule:
    """A better name for a column, such as one that was numbered for want of a header."""
    return _rule("rename_column", column, f"Rename '{column}' to '{new_name}'", new_name=new_name)


def custom(column: str, name: str) -> Rule:
    """Apply the function registered under ``name``."""
    return _rule("custom", column, f"Apply '{name}' to '{column}'", name=name)


def drop_empty_rows() -> Rule:
    return _rule("drop_empty_rows", None, "Drop rows that are null in every column")


def drop_empty_columns() -> Rule:
    return _rule("drop_empty_columns", None, "Drop columns that are null in every row")


def dedupe_exact() -> Rule:
    return _rule("dedupe_exact", None, "Keep the first of identical rows")


def trim_text(column: str) -> Rule:
    return _rule("trim_text", column, "Remove outer whitespace")


def blank_to_null(column: str) -> Rule:
    return _rule("blank_to_null", column, "Turn blank text into null")


def junk_to_null(
    column: str, extra_patterns: list[str] | None = None, convert_text_zeros: bool = False
) -> Rule:
    return _rule(
        "junk_to_null",
        column,
        "Turn placeholder text into null",
        extra_patterns=extra_patterns or [],
        convert_text_zeros=convert_text_zeros,
    )


def to_numeric_strict(column: str) -> Rule:
    return _rule("to_numeric_strict", column, "Convert to numbers, or abort if a value would be lost")


def normalize_case(column: str, format: str = "upper") -> Rule:
    return _rule("normalize_case", column, f"Write text in {format} case", format=format)


def normalize_dates(
    column: str, dayfirst: bool = True, allow_time: bool = False, pivot_year: int | None = None
) -> Rule:
    return _rule(
        "normalize_dates",
        column,
        "Write dates as yyyy-MM-dd",
        dayfirst=dayfirst,
        allow_time=allow_time,
        pivot_year=pivot_year or default_pivot_year(),
    )


def normalize_numbers(
    column: str,
    locale: str = "auto",
    remove_currency: bool = True,
    handle_parentheses_negatives: bool = True,
    convert_percentages: bool = False,
) -> Rule:
    return _rule(
        "normalize_numbers",
        column,
        "Read amounts as numbers",
        locale=locale,
        remove_currency=remove_currency,
        handle_parentheses_negatives=handle_parentheses_negatives,
        convert_percentages=convert_percentages,
    )


def dedupe_by_key(columns: str | list[str], keep: str = "first") -> Rule:
    """Keys are a list or a comma-separated text of column names."""
    names = _names(columns, "key columns")
    return _rule(
        "dedupe_by_key", names[0], f"Keep the {keep} row of each key", subset_columns=names, keep=keep
    )


def split_column(column: str, delimiter: str, new_column_names: str | list[str]) -> Rule:
    names = _names(new_column_names, "new column names")
    return _rule(
        "split_column",
        column,
        f"Split on {delimiter!r}",
        delimiter=delimiter,
        new_column_names=names,
    )


def merge_columns(
    source_columns: str | list[str],
    new_column_name: str,
    separator: str = " ",
    drop_source_columns: bool = False,
) -> Rule:
    names = _names(source_columns, "source columns")
    if len(names) < 2:
        raise RuleError("merge_columns: at least two source columns are needed")
    return _rule(
        "merge_columns",
        None,
        f"Join {names} as '{new_column_name}'",
        source_columns=names,
        new_column_name=new_column_name.strip(),
        separator=separator,
        drop_source_columns=drop_source_columns,
    )


def replace_values(column: str, mappings: list[dict[str, Any]]) -> Rule:
    return _rule("replace_values", column, "Replace listed values", mappings=mappings)


def strip_invisibles(column: str) -> Rule:
    return _rule("strip_invisibles", column, "Remove line breaks and invisible characters")


def flag_for_review(column: str | None, reason: str = "Needs a human decision") -> Rule:
    return _rule("flag_for_review", column, reason)
