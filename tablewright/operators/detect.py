"""Issue detectors. Each returns a DataFrame of issues; :func:`analyze` runs all of them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.columns import (
    ROW_ID,
    column,
    count_if,
    data_columns,
    is_text,
    number_columns,
    present,
    text_columns,
    type_of,
)
from tablewright.functions import constants as K
from tablewright.functions import text as cells
from tablewright.functions.dates import date_text, date_value, default_pivot_year, year_first
from tablewright.operators.profile import affected_ratio, profile, table_stats
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.values import first_per_group, order_column, spelling_groups

EXAMPLES = 3
#: Parts of the rows whose first hits bound where examples can lie.
BUCKETS = 16
ISSUE_SCHEMA = (
    "position int, category string, column string, severity string, affected bigint, total bigint, "
    "ratio double, examples array<string>, suggested_action string, description string, "
    "recommendation string"
)

# category: (severity, suggested action, description, recommendation), in emission order.
CATALOG = {
    "auto_named_column": ("MEDIUM", "flag_for_review", "The column had no header and was named automatically.", "Give the column its business name before publishing."),
    "empty_rows": ("MEDIUM", "drop_empty_rows", "Rows without a value in any column.", "Drop these rows."),
    "empty_columns": ("MEDIUM", "drop_empty_columns", "Columns without any value.", "Drop these columns."),
    "exact_duplicates": ("MEDIUM", "dedupe_exact", "Rows equal to an earlier row in every column.", "Keep the first of each."),
    "possible_duplicates": ("LOW", "flag_for_review", "Rows that differ only in case or outer spaces.", "Review before removing."),
    "missing_values": ("", "flag_for_review", "Missing values.", "Decide whether to fill, drop or keep them."),
    "blank_strings": ("LOW", "blank_to_null", "Text without content.", "Turn it into null."),
    "extra_whitespace": ("LOW", "trim_text", "Outer whitespace.", "Trim the text."),
    "case_variants": ("LOW", "normalize_case", "The same value in different upper and lower case.", "Use one spelling."),
    "numbers_as_text": ("MEDIUM", "to_numeric_strict", "Numbers stored as text.", "Convert the column to numbers."),
    "iqr_outliers": ("LOW", "flag_for_review", "Values far outside the middle half.", "Review them."),
    "inconsistent_dates": ("MEDIUM", "normalize_dates", "Values that are no known date.", "Write dates in one format."),
    "suspicious_emails": ("MEDIUM", "flag_for_review", "Values that are no e-mail address.", "Review them."),
    "suspicious_phones": ("LOW", "flag_for_review", "Values that are no phone number.", "Review them."),
}
_ORDER = {category: i for i, category in enumerate(CATALOG)}
_WIDTH = 100_000
COLUMNS_PER_SCAN = 16


@dataclass
class Check:
    """A countable condition on the rows: affected where ``flag``, out of ``counted`` (or all rows)."""

    category: str
    name: str | None
    flag: Column
    counted: Column | None
    place: int = 0
    value: Column | None = None
    gate: str = "true"
    severity: str = ""
    total: int | None = None


def _literal(value: str | None) -> str:
    """SQL text literal; the rows of issues are built as SQL text, one call per check."""
    if value is None:
        return "cast(null as string)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _severity(check: Check, affected: str, total: str) -> str:
    if check.category == "missing_values":
        ratio = f"{affected} / {total}"
        return f"case when {ratio} > 0.5 then 'HIGH' when {ratio} > 0.1 then 'MEDIUM' else 'LOW' end"
    return _literal(CATALOG[check.category][0])


def _issue_row(i: int, check: Check) -> Column:
    affected, total = f"a{i}", f"t{i}" if check.total is None else f"cast({check.total} as bigint)"
    kept = f"{affected} > 0 and ({check.gate.replace('affected', affected).replace('total', total)})"
    row = (
        f"named_struct('check', {i}, 'position', {_ORDER[check.category] * _WIDTH + check.place}, "
        f"'category', {_literal(check.category)}, 'column', {_literal(check.name)}, "
        f"'severity', {_severity(check, affected, total)}, 'affected', {affected}, 'total', {total})"
    )
    return F.expr(f"case when {kept} then {row} end")


def _run_checks(
    df: DataFrame, checks: Sequence[Check], examples: bool = True, order_by: str | None = None
) -> DataFrame:
    """All checks in one aggregate, turned into issue rows; examples come from a second branch."""
    if not checks:
        return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    sums = []
    for i, check in enumerate(checks):
        sums.append(count_if(check.flag).alias(f"a{i}"))
        sums.append(F.count(F.lit(1) if check.counted is None else F.when(check.counted, 1)).alias(f"t{i}"))
    places = {check.place for check in checks}
    found = F.array_compact(F.array(*[_issue_row(i, check) for i, check in enumerate(checks)]))
    shown = [(i, c) for i, c in enumerate(checks) if c.value is not None] if examples else []
    bounds: dict[int, int | None] = {}
    if shown and _bounded(df, order_by):
        counted, bounds = _counts_and_bounds(_with_texts(df, places), sums, shown, order_by)
        shown = [(i, c) for i, c in shown if i in bounds]
    else:
        counted = _with_texts(df, places).agg(*sums)
    issues = counted.select(F.inline(found))
    if shown:
        found = _examples(df, places, shown, order_by, bounds)
        # At most one row per check on this side.
        issues = issues.join(F.broadcast(found), "check", "left")
    else:
        issues = issues.withColumn("examples", F.lit(None).cast("array<string>"))
    return _finish(issues)


def _bounded(df: DataFrame, order_by: str | None) -> bool:
    """Whether rows have an order in whole numbers, which a hash aggregate can hold."""
    order = order_by or (ROW_ID if ROW_ID in df.columns else None)
    return order is not None and isinstance(type_of(df, order), T.IntegralType)


def _counts_and_bounds(
    df: DataFrame, sums: Sequence[Column], shown: Sequence[tuple[int, Check]], order_by: str | None
) -> tuple[DataFrame, dict[int, int | None]]:
    """The counts as one row, and for each check with a hit the order that its examples do not exceed.

    Rows are dealt to a few buckets. A flagged row of each of ``EXAMPLES`` buckets comes no later than
    that one of their first ones that comes last, so no example comes later. None: hits in fewer buckets.
    """
    first = order_column(df, order_by)
    least = [F.min(F.when(c.flag, first)).alias(f"m{i}") for i, c in shown]
    parts = df.groupBy(F.pmod(F.xxhash64(first), F.lit(BUCKETS)).alias("_bucket")).agg(*sums, *least)
    names = [c for c in parts.columns if c[0] in "at"]
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]
    ends = [F.get(F.sort_array(F.collect_list(f"m{i}")), F.lit(EXAMPLES - 1)).alias(f"m{i}") for i, _ in shown]
    row = parts.agg(*totals, *ends).first()
    counted = df.sparkSession.createDataFrame([tuple(row[c] for c in names)], ", ".join(f"{c} bigint" for c in names))
    return counted, {i: row[f"m{i}"] for i, _ in shown if row[f"a{i}"] > 0}


def _examples(
    df: DataFrame, places: set[int], shown: list[tuple[int, Check]], order_by: str | None, bounds: dict[int, int | None]
) -> DataFrame:
    """(check, examples). Only rows up to the bounds are judged and sorted, where there are bounds."""
    first = order_column(df, order_by)

    def near(bound: int | None) -> Column:
        # Rows without an order come first.
        return F.lit(True) if bound is None else first.isNull() | (first <= bound)

    ends = [bounds.get(i) for i, _ in shown]
    df = _with_texts(df.filter(near(None if None in ends else max(ends))), places)
    flagged = [
        F.when(near(bounds.get(i)) & c.flag, F.struct(F.lit(i).alias("check"), c.value.alias("value"))) for i, c in shown
    ]
    rows = df.select(
        order_column(df, order_by).alias("_first"), F.explode(F.array_compact(F.array(*flagged))).alias("hit")
    ).select("_first", "hit.check", "hit.value")
    return first_per_group(rows, ["check"], ["_first", "value"], EXAMPLES)


def _finish(issues: DataFrame) -> DataFrame:
    """Add the fixed texts and put the columns in their order."""

    def text(index: int) -> Column:
        cases = " ".join(f"when {_literal(c)} then {_literal(entry[index])}" for c, entry in CATALOG.items())
        return F.expr(f"case category {cases} end")

    return issues.select(
        "position",
        "category",
        "column",
        "severity",
        "affected",
        "total",
        affected_ratio(F.col("affected"), F.col("total")).alias("ratio"),
        F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
        text(1).alias("suggested_action"),
        text(2).alias("description"),
        text(3).alias("recommendation"),
    )


def _with_texts(df: DataFrame, places: set[int]) -> DataFrame:
    """Add the stripped text of the columns in question, computed once for all their checks."""
    names = data_columns(df)
    wanted = sorted(places)
    texts = df.select(
        "*",
        *[
            cells.strip(cells.as_text(present(df, names[i]), type_of(df, names[i]))).alias(f"_text{i}")
            for i in wanted
        ],
    )
    # The two steps of reading dates; columns that no check reads are pruned by the optimizer.
    dated = [i for i in wanted if is_text(df, names[i])]
    plain = texts.select("*", *[date_text(F.col(f"_text{i}")).alias(f"_plain{i}") for i in dated])
    pivot = default_pivot_year()
    return plain.select(
        "*", *[year_first(F.col(f"_plain{i}"), False, pivot, True).alias(f"_ordered{i}") for i in dated]
    )


def _text_of(df: DataFrame, name: str) -> Column:
    return F.col(f"_text{data_columns(df).index(name)}")


def _places(df: DataFrame, columns: Sequence[str] | None, default: Sequence[str]) -> list[tuple[int, str]]:
    wanted = set(columns if columns is not None else default)
    return [(i, name) for i, name in enumerate(data_columns(df)) if name in wanted]


def _hinted(df: DataFrame, hint: str, columns: Sequence[str] | None) -> list[tuple[int, str]]:
    return _places(
        df, columns, [n for n in data_columns(df) if re.search(hint, n, re.IGNORECASE)]
    )


def _only_text(df: DataFrame, columns: Sequence[str] | None) -> list[tuple[int, str]]:
    return [(i, n) for i, n in _places(df, columns, text_columns(df)) if is_text(df, n)]


def _auto_named_checks(df, columns=None):
    names = [n for n in data_columns(df) if re.fullmatch(K.AUTO_NAME, n)]
    return [
        Check("auto_named_column", n, present(df, n).isNotNull(), None, i)
        for i, n in _places(df, columns, names)
        if n in names
    ]


def _empty_row_checks(df):
    names = data_columns(df)
    filled = [F.when(present(df, n).isNotNull(), True) for n in names]
    return [Check("empty_rows", None, F.coalesce(*filled).isNull(), None)]


def _missing_checks(df, columns=None):
    return [
        Check("missing_values", n, present(df, n).isNull(), None, i)
        for i, n in _places(df, columns, data_columns(df))
    ]


def _blank_checks(df, columns=None):
    return [
        Check("blank_strings", n, _text_of(df, n) == "", column(n).isNotNull(), i)
        for i, n in _only_text(df, columns)
    ]


def _whitespace_checks(df, columns=None):
    return [
        Check("extra_whitespace", n, column(n) != _text_of(df, n), column(n).isNotNull(), i)
        for i, n in _only_text(df, columns)
    ]


def _number_text_checks(df, columns=None, min_ratio=0.9):
    return [
        Check(
            "numbers_as_text",
            n,
            _text_of(df, n).rlike(K.NUMBER_LIKE),
            column(n).isNotNull(),
            i,
            _text_of(df, n),
            f"affected >= {min_ratio} * total",
        )
        for i, n in _only_text(df, columns)
    ]


def _date_checks(df, columns=None, min_ratio=0.6, hint=K.DATE_NAME_HINT):
    checks = []
    for i, n in _only_text(df, columns):
        text = _text_of(df, n)
        filled = text != ""
        hinted = re.search(hint, n, re.IGNORECASE)
        checks.append(
            Check(
                "inconsistent_dates",
                n,
                filled & date_value(text, F.col(f"_plain{i}"), F.col(f"_ordered{i}"), True).isNull(),
                filled,
                i,
                text,
                "true" if hinted else f"total - affected >= {min_ratio} * total",
            )
        )
    return checks


def _email_checks(df, columns=None, hint=K.EMAIL_NAME_HINT):
    return [
        Check(
            "suspicious_emails",
            n,
            ~_text_of(df, n).rlike(K.EMAIL_VALID),
            present(df, n).isNotNull(),
            i,
            _text_of(df, n),
        )
        for i, n in _hinted(df, hint, columns)
    ]


def _phone_checks(df, columns=None, hint=K.PHONE_NAME_HINT):
    checks = []
    for i, n in _hinted(df, hint, columns):
        text = _text_of(df, n)
        digits = cells.digit_count(text)
        bad = ~text.rlike(K.PHONE_ALLOWED) | (digits < K.PHONE_DIGITS[0]) | (digits > K.PHONE_DIGITS[1])
        checks.append(Check("suspicious_phones", n, bad, present(df, n).isNotNull(), i, text))
    return checks


def _outlier_checks(df, columns=None, min_samples=10, quantiles=None):
    numeric = set(number_columns(df))
    places = [(i, n) for i, n in _places(df, columns, numeric) if n in numeric]
    bounds = quantiles if quantiles is not None else exact_quantiles(df, [n for _, n in places], (0.25, 0.75))
    checks = []
    for i, n in places:
        if bounds.get(n) is None or bounds[n][0] == bounds[n][1]:
            continue
        low, high = bounds[n]
        reach = 1.5 * (high - low)
        cell = present(df, n).cast("double")
        checks.append(
            Check(
                "iqr_outliers",
                n,
                (cell < low - reach) | (cell > high + reach),
                cell.isNotNull(),
                i,
                cells.as_text(column(n), type_of(df, n)),
                f"total >= {min_samples}",
            )
        )
    return checks


def auto_named_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns named by the reader because their header was blank."""
    return _run_checks(df, _auto_named_checks(df, columns))


def empty_rows(df: DataFrame) -> DataFrame:
    return _run_checks(df, _empty_row_checks(df))


def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _run_checks(df, _missing_checks(df, columns))


def blank_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _run_checks(df, _blank_checks(df, columns))


def extra_whitespace(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _run_checks(df, _whitespace_checks(df, columns))


def numbers_as_text(
    df: DataFrame, columns: Sequence[str] | None = None, min_ratio: float = 0.9,
    examples: bool = True, order_by: str | None = None,
) -> DataFrame:
    return _run_checks(df, _number_text_checks(df, columns, min_ratio), examples, order_by)


def inconsistent_dates(
    df: DataFrame, columns: Sequence[str] | None = None, min_ratio: float = 0.6,
    examples: bool = True, order_by: str | None = None,
) -> DataFrame:
    """The share that decides is taken over the whole column, not over a sample."""
    return _run_checks(df, _date_checks(df, columns, min_ratio), examples, order_by)


def suspicious_emails(
    df: DataFrame, columns: Sequence[str] | None = None, examples: bool = True, order_by: str | None = None
) -> DataFrame:
    return _run_checks(df, _email_checks(df, columns), examples, order_by)


def suspicious_phones(
    df: DataFrame, columns: Sequence[str] | None = None, examples: bool = True, order_by: str | None = None
) -> DataFrame:
    return _run_checks(df, _phone_checks(df, columns), examples, order_by)


def iqr_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, min_samples: int = 10,
    examples: bool = True, order_by: str | None = None,
) -> DataFrame:
    """Exact quartiles first (a few aggregates), then one counting pass with them as constants."""
    return _run_checks(df, _outlier_checks(df, columns, min_samples), examples, order_by)


def empty_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One issue that lists the first five columns without any value."""
    names = [n for _, n in _places(df, columns, data_columns(df))]
    row = df.agg(*[F.count(present(df, n)).alias(f"c{i}") for i, n in enumerate(names)])
    empty = F.array_compact(
        F.array(*[F.when(F.col(f"c{i}") == 0, F.lit(n)) for i, n in enumerate(names)])
    )
    issue = row.select(empty.alias("empty")).select(
        F.lit(_ORDER["empty_columns"] * _WIDTH).alias("position"),
        F.lit("empty_columns").alias("category"),
        F.lit(None).cast("string").alias("column"),
        F.lit(CATALOG["empty_columns"][0]).alias("severity"),
        F.size("empty").cast("long").alias("affected"),
        F.lit(len(data_columns(df))).cast("long").alias("total"),
        F.slice("empty", 1, 5).alias("examples"),
    )
    return _finish(issue.filter(F.col("affected") > 0))


def duplicate_counts(df: DataFrame) -> DataFrame:
    """One row: (total, exact, possible).

    Equal rows are grouped first, then the distinct rows by their normalised text. A normalised
    group with v different spellings holds v - 1 possible duplicates.
    """
    names = data_columns(df)
    rows = df.groupBy(*[present(df, n).alias(n) for n in names]).agg(F.count(F.lit(1)).alias("_copies"))
    loose = [
        F.lower(cells.strip(column(n))).alias(n) if is_text(df, n) else column(n) for n in names
    ]
    groups = rows.groupBy(*loose).agg(
        F.sum("_copies").alias("_copies"), F.count(F.lit(1)).alias("_variants")
    )
    zero = F.lit(0).cast("long")
    return groups.agg(
        F.coalesce(F.sum("_copies"), zero).alias("total"),
        F.coalesce(F.sum(F.col("_copies") - F.col("_variants")), zero).alias("exact"),
        F.coalesce(F.sum(F.col("_variants") - 1), zero).alias("possible"),
    )


def _duplicate_issues(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    counts = duplicate_counts(df)
    rows = [
        F.struct(
            F.lit(_ORDER[category] * _WIDTH).alias("position"),
            F.lit(category).alias("category"),
            F.lit(None).cast("string").alias("column"),
            F.lit(CATALOG[category][0]).alias("severity"),
            F.col(counted).alias("affected"),
            F.col("total"),
            F.lit(None).cast("array<string>").alias("examples"),
        )
        for category, counted in (("exact_duplicates", "exact"), ("possible_duplicates", "possible"))
        if category in wanted and (counted == "exact" or text_columns(df))
    ]
    if not rows:
        return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    return _finish(counts.select(F.inline(F.array(*rows))).filter(F.col("affected") > 0))


def exact_duplicates(df: DataFrame) -> DataFrame:
    names = data_columns(df)
    groups = df.groupBy(*[present(df, n).alias(n) for n in names]).agg(F.count(F.lit(1)).alias("_copies"))
    counted = groups.agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).cast("long").alias("affected"),
        F.coalesce(F.sum("_copies"), F.lit(0)).cast("long").alias("total"),
    )
    return _finish(
        counted.filter(F.col("affected") > 0).select(
            F.lit(_ORDER["exact_duplicates"] * _WIDTH).alias("position"),
            F.lit("exact_duplicates").alias("category"),
            F.lit(None).cast("string").alias("column"),
            F.lit(CATALOG["exact_duplicates"][0]).alias("severity"),
            "affected",
            "total",
            F.lit(None).cast("array<string>").alias("examples"),
        )
    )


def possible_duplicates(df: DataFrame) -> DataFrame:
    return _duplicate_issues(df, ["possible_duplicates"])


def case_variants(
    df: DataFrame, columns: Sequence[str] | None = None, examples: bool = True
) -> DataFrame:
    """Columns where one value is spelled with different upper and lower case."""
    places = _only_text(df, columns)
    if not places:
        return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    groups = spelling_groups(df, [n for _, n in places])
    mixed = F.col("spellings") > 1
    counted = groups.groupBy("pos").agg(
        F.sum(F.when(mixed, F.col("n")).otherwise(0)).alias("affected"), F.sum("n").alias("total")
    ).filter(F.col("affected") > 0)
    if examples:
        keys = groups.filter(mixed).select("pos", F.col("key").alias("value"))
        # At most one row per column on this side.
        counted = counted.join(F.broadcast(first_per_group(keys, ["pos"], ["value"], EXAMPLES)), "pos", "left")
    else:
        counted = counted.withColumn("examples", F.lit(None).cast("array<string>"))
    name = F.element_at(F.array(*[F.lit(n) for _, n in places]), F.col("pos").cast("int") + 1)
    place = F.element_at(F.array(*[F.lit(i) for i, _ in places]), F.col("pos").cast("int") + 1)
    return _finish(
        counted.select(
            (F.lit(_ORDER["case_variants"] * _WIDTH) + place).alias("position"),
            F.lit("case_variants").alias("category"),
            name.alias("column"),
            F.lit(CATALOG["case_variants"][0]).alias("severity"),
            "affected",
            "total",
            "examples",
        )
    )


@dataclass(frozen=True)
class Report:
    table_stats: DataFrame
    profile: DataFrame
    issues: DataFrame


def analyze_issues(df: DataFrame, examples: bool = True, order_by: str | None = None) -> DataFrame:
    """Issues of all detectors, in emission order by ``position``.

    The row-level checks of a column share one aggregate; only duplicates and spelling variants,
    which need a shuffle of the data, add a branch of their own.
    """
    names = data_columns(df)
    bounds = exact_quantiles(df, number_columns(df), (0.25, 0.75))
    parts = [_run_checks(df, _empty_row_checks(df))]
    # A scan per group of columns reads each column once, like one scan of all, but keeps the
    # generated code of a wide table small.
    for at in range(0, len(names), COLUMNS_PER_SCAN):
        some = names[at : at + COLUMNS_PER_SCAN]
        checks = [
            *_auto_named_checks(df, some),
            *_missing_checks(df, some),
            *_blank_checks(df, some),
            *_whitespace_checks(df, some),
            *_number_text_checks(df, some),
            *_outlier_checks(df, some, quantiles=bounds),
            *_date_checks(df, some),
            *_email_checks(df, [n for n in some if re.search(K.EMAIL_NAME_HINT, n, re.IGNORECASE)]),
            *_phone_checks(df, [n for n in some if re.search(K.PHONE_NAME_HINT, n, re.IGNORECASE)]),
        ]
        parts.append(_run_checks(df, checks, examples, order_by))
    parts += [
        empty_columns(df),
        _duplicate_issues(df, ["exact_duplicates", "possible_duplicates"]),
        case_variants(df, examples=examples),
    ]
    return reduce(DataFrame.unionByName, parts)


def analyze(df: DataFrame, examples: bool = True, order_by: str | None = None) -> Report:
    return Report(
        table_stats(df), profile(df, order_by=order_by), analyze_issues(df, examples, order_by)
    )
