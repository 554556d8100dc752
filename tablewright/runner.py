"""One cleaning run: stage, apply, validate against storage, publish, audit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.columns import ROW_ID, data_columns
from tablewright.operators.audit import transforms
from tablewright.operators.validate import CleanResult, ValidationResult, validate
from tablewright.plans.plan import Plan
from tablewright.session import new_path
from tablewright.sinks.audit_log import AuditRun
from tablewright.sinks.publish import PublishResult, publish


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a table to the shared folder and read it back; cuts lineage and survives executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stage_with_row_id(df: DataFrame) -> DataFrame:
    """Stage a table with row numbers that follow the order of the scan.

    The numbers are only stable once written, because a re-planned scan would number anew.
    """
    if ROW_ID in df.columns:
        return stage(df, "source")
    return stage(df.select(F.monotonically_increasing_id().alias(ROW_ID), "*"), "source")


@dataclass(frozen=True)
class RunOutcome:
    cleaned: DataFrame
    result: CleanResult
    validation: ValidationResult
    published: PublishResult | None
    audit: AuditRun


def loss_warnings(losses: DataFrame) -> list[str]:
    """One note per rule that nulled values or dropped parts (one row per rule)."""
    return [
        f"{r.action}: {r.lost} value(s) of column '{r.column}' were lost"
        for r in losses.filter("lost > 0").orderBy("position").collect()
    ]


def clean_table(
    df: DataFrame,
    plan: Plan,
    target: str | None = None,
    format: str = "parquet",
    overwrite: bool = False,
    audit_base: str | None = None,
    source: str = "",
    language: str = "es",
    order_by: Sequence[str] | None = None,
    staged: bool = False,
) -> RunOutcome:
    """Write-audit-publish for one table. Without a target the checked result is only returned.

    ``staged`` tells that the table is read from storage with its row ids, as ``read_text`` gives it,
    so that it is not written again.
    """
    spark: SparkSession = df.sparkSession
    original = df if staged else stage_with_row_id(df)
    plan.check_strict(original, order_by)
    cleaned, losses = plan.apply_counted(original, lambda table: stage(table, "candidate"), order_by)
    warnings = [*plan.warnings(original), *loss_warnings(losses)]
    result = CleanResult(
        plan.applied,
        original.count(),
        cleaned.count(),
        len(data_columns(original)),
        len(data_columns(cleaned)),
        tuple(warnings),
    )
    validation = validate(original, cleaned, plan, result, order_by)
    audit = AuditRun(source, target or "", result, validation, plan, transforms(plan, original, cleaned), language)
    published = None
    if target and validation.valid:
        published = publish(cleaned, target, validation, format, overwrite)
    if audit_base:
        audit.write(spark, audit_base)
    return RunOutcome(cleaned, result, validation, published, audit)
