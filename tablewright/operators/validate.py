"""Independent validation: evaluate the approved plan a second time, by other code, and compare."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.columns import ROW_ID, column, count_if, data_columns, quoted, type_of
from tablewright.operators import recheck
from tablewright.plans.plan import Plan
from tablewright.plans.rules import ACTIONS, Rule, RuleError, problems


@dataclass(frozen=True)
class CleanResult:
    """What a cleaning run claims to have done."""

    applied: tuple[Rule, ...]
    rows_before: int
    rows_after: int
    columns_before: int
    columns_after: int
    warnings: tuple[str, ...] = ()


@dataclass(frozen=True)
class ValidationResult:
    valid: bool
    errors: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()
    differences: dict[str, int] = field(default_factory=dict)


def unauthorised(applied: DataFrame, approved: DataFrame) -> DataFrame:
    """Applied (action, column) pairs that no approval covers; a null column matches only null."""
    pair = (applied["action"] == approved["action"]) & applied["column"].eqNullSafe(approved["column"])
    return applied.join(approved, pair, "left_anti")


#: Key buckets whose digests are compared before any cell is.
BUCKETS = 4_096


def bucket_digests(df: DataFrame, key: Sequence[str], names: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, rows, four sums) of a table: equal tables have equal rows here, in any order of rows.

    Each row is hashed twice with the places of its nulls, which a hash alone would skip; the halves
    of the hashes are summed, so equal rows do not cancel out and no sum overflows.
    """
    nulls = [
        reduce(lambda a, b: a.bitwiseOR(b), [F.when(column(n).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(part)])
        for part in ([*key, *names][i : i + 30] for i in range(0, len(key) + len(names), 30))
    ]
    cells = [*map(column, [*key, *names]), *nulls]
    hashed = df.select(
        F.pmod(F.xxhash64(*map(column, key)), F.lit(buckets)).cast("int").alias("bucket"), F.xxhash64(*cells).alias("h"), F.xxhash64(F.lit(1), *cells).alias("i")
    )
    low, high = (lambda h: F.col(h).bitwiseAND(F.lit(0xFFFFFFFF))), (lambda h: F.shiftright(h, 32))
    sums = [F.sum(half(h)).alias(f"{h}{k}") for h in ("h", "i") for k, half in enumerate((low, high))]
    return hashed.groupBy("bucket").agg(F.count("*").alias("rows"), *sums)


def differing_buckets(expected: DataFrame, candidate: DataFrame, key: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket) of the key buckets in which two tables differ; none if they are equal.

    One partial aggregate over each table; only the digests are shuffled, a row per bucket and task.
    """
    names = [n for n in data_columns(expected) if n not in key]
    sides = [bucket_digests(side, key, names, buckets) for side in (expected, candidate)]
    values = [c for c in sides[0].columns if c != "bucket"]
    return sides[0].unionByName(sides[1]).groupBy("bucket", *values).count().filter("count = 1").select("bucket").distinct()


def _hashable(data_type: T.DataType) -> bool:
    return not any(name in data_type.simpleString() for name in ("map<", "variant"))


def cell_differences(
    expected: DataFrame, candidate: DataFrame, key: Sequence[str] = (ROW_ID,)
) -> DataFrame:
    """(column, differing) for every data column, plus rows missing or extra in the candidate.

    Digests by bucket of the key are compared first. Cells are joined for the buckets that differ
    only, so equal tables need no join. Nulls equal nulls and NaN equals NaN.
    """
    names = [n for n in data_columns(expected) if n not in key]
    entries = ["(missing rows)", "(extra rows)", *names]
    both_types = [(type_of(expected, n), type_of(candidate, n)) for n in (*key, *names)]
    if all(_hashable(a) and a.simpleString() == b.simpleString() for a, b in both_types):
        # At most BUCKETS numbers.
        found = [row.bucket for row in differing_buckets(expected, candidate, key).collect()]
        if not found:
            spark = expected.sparkSession
            return spark.createDataFrame([(n, 0) for n in entries], "column string, differing long")
        if len(found) < BUCKETS / 2:
            bucket = F.pmod(F.xxhash64(*map(column, key)), F.lit(BUCKETS)).cast("int")
            expected, candidate = (side.filter(bucket.isin(found)) for side in (expected, candidate))
    return _joined_differences(expected, candidate, key, names)


def _joined_differences(expected: DataFrame, candidate: DataFrame, key: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One equi-join on the row key and one aggregate."""
    left = expected.select(
        *[column(k) for k in key],
        F.lit(True).alias("_e"),
        *[column(n).alias(f"e{i}") for i, n in enumerate(names)],
    )
    right = candidate.select(
        *[column(k) for k in key],
        F.lit(True).alias("_c"),
        *[column(n).alias(f"c{i}") for i, n in enumerate(names)],
    )
    both = F.col("_e").isNotNull() & F.col("_c").isNotNull()
    counted = left.join(right, list(key), "full_outer").agg(
        count_if(F.col("_c").isNull()).alias("missing"),
        count_if(F.col("_e").isNull()).alias("extra"),
        *[
            count_if(both & ~F.col(f"e{i}").eqNullSafe(F.col(f"c{i}"))).alias(f"d{i}")
            for i in range(len(names))
        ],
    )
    entries = [("(missing rows)", "missing"), ("(extra rows)", "extra")]
    entries += [(n, f"d{i}") for i, n in enumerate(names)]
    return counted.select(
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("column"), F.col(c).alias("differing")) for n, c in entries])
        )
    )


def row_differences(
    expected: DataFrame, candidate: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows with unequal multiplicity, as (columns..., surplus): negative if the candidate lacks them.

    For tables without a row key. One signed grouping, so copies of a row collapse before the
    shuffle; it cannot see a mere reordering.
    """
    names = list(columns or data_columns(expected))
    sides = [
        side.select(*[column(n) for n in names], F.lit(sign).cast("long").alias("_sign"))
        for side, sign in ((expected, -1), (candidate, 1))
    ]
    grouped = sides[0].unionByName(sides[1]).groupBy(*[column(n) for n in names])
    return grouped.agg(F.sum("_sign").alias("surplus")).filter(F.col("surplus") != 0)


def structure_errors(expected: DataFrame, candidate: DataFrame) -> list[str]:
    """Differences in column names, their order and their types."""
    errors = []
    if data_columns(expected) != data_columns(candidate):
        errors.append(
            f"columns differ: expected {data_columns(expected)}, found {data_columns(candidate)}"
        )
        return errors
    for name in data_columns(expected):
        wanted, found = type_of(expected, name), type_of(candidate, name)
        if wanted.simpleString() != found.simpleString():
            errors.append(f"column '{name}' is {found.simpleString()}, expected {wanted.simpleString()}")
    return errors


def authorisation_errors(plan: Plan, applied: Sequence[Rule]) -> list[str]:
    allowed = {(rule.action, rule.column) for rule in plan.approved}
    errors = []
    for rule in applied:
        if (rule.action, rule.column) not in allowed:
            errors.append(f"{rule.action} on '{rule.column}' was applied without approval")
        elif not rule.approved:
            errors.append(f"{rule.action} on '{rule.column}' is recorded as applied but not approved")
    return errors


def validate(
    original: DataFrame,
    candidate: DataFrame,
    plan: Plan,
    result: CleanResult | None = None,
    order_by: Sequence[str] | None = None,
    key: Sequence[str] | None = None,
) -> ValidationResult:
    """Check a persisted candidate against a second evaluation of the approved rules on the original.

    That evaluation interprets the rules from decision tables of its own (``recheck``), so a fault in
    a rule does not validate itself.

    ``candidate`` must be read back from storage: comparing a lazy result with itself proves
    nothing. With a row key (``_row_id`` by default) cells are compared row by row, else rows are
    compared as a multiset.
    """
    errors: list[str] = []
    warnings = [
        f"pending review: {rule.action} on '{rule.column}'"
        for rule in plan.rules
        if rule.action == "flag_for_review" and not rule.approved
    ]
    unknown = [rule.action for rule in plan.approved if rule.action not in ACTIONS]
    if unknown:
        return ValidationResult(False, (f"unknown actions {unknown}",), tuple(warnings))
    for rule in plan.approved:
        errors.extend(problems(rule))
    if errors:
        return ValidationResult(False, tuple(errors), tuple(warnings))
    if result is not None:
        errors.extend(authorisation_errors(plan, result.applied))
    try:
        plan.check_strict(original, order_by)
        expected = recheck.evaluate(plan, original, order_by)
    except RuleError as error:
        return ValidationResult(False, (*errors, str(error)), tuple(warnings))
    structure = structure_errors(expected, candidate)
    if result is not None:
        errors.extend(_metadata_errors(original, candidate, result))
    if structure:
        return ValidationResult(False, (*errors, *structure), tuple(warnings))
    if key is None and ROW_ID in expected.columns and ROW_ID in candidate.columns:
        key = [c for c in ("_source_file", ROW_ID) if c in expected.columns]
    differences: dict[str, int] = {}
    if key:
        # One row per column of the table.
        for row in cell_differences(expected, candidate, key).collect():
            if row.differing:
                differences[row.column] = row.differing
                errors.append(f"{row.differing} cells or rows differ: {row.column}")
    else:
        surplus = row_differences(expected, candidate).agg(
            F.coalesce(F.sum(F.when(F.col("surplus") < 0, -F.col("surplus"))), F.lit(0)).alias("missing"),
            F.coalesce(F.sum(F.when(F.col("surplus") > 0, F.col("surplus"))), F.lit(0)).alias("extra"),
        ).first()
        for label in ("missing", "extra"):
            if surplus[label]:
                differences[f"({label} rows)"] = surplus[label]
                errors.append(f"{surplus[label]} rows are {label}")
    return ValidationResult(not errors, tuple(errors), tuple(warnings), differences)


def _metadata_errors(original: DataFrame, candidate: DataFrame, result: CleanResult) -> list[str]:
    found = {
        "rows_before": original.count(),
        "rows_after": candidate.count(),
        "columns_before": len(data_columns(original)),
        "columns_after": len(data_columns(candidate)),
    }
    return [
        f"{name} is recorded as {getattr(result, name)} but is {value}"
        for name, value in found.items()
        if getattr(result, name) != value
    ]
