"""Audit tables: one run row, its actions and its transforms."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tablewright import __version__
from tablewright.operators.validate import CleanResult, ValidationResult
from tablewright.plans.plan import Plan
from tablewright.sinks.publish import with_run

LANGUAGES = ("es", "en")
RUN_SCHEMA = (
    "run_id string, started_at timestamp, finished_at timestamp, source string, target string, "
    "rows_before bigint, rows_after bigint, rows_removed bigint, columns_before int, "
    "columns_after int, valid boolean, errors array<string>, validation_warnings array<string>, "
    "cleaning_warnings array<string>, language string, version string"
)
ACTION_SCHEMA = (
    "run_id string, position int, action string, column string, parameters string, "
    "description string, approved boolean, applied boolean, source string"
)


@dataclass
class AuditRun:
    source: str
    target: str
    result: CleanResult
    validation: ValidationResult
    plan: Plan
    transforms: DataFrame
    language: str = "es"
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    started_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def __post_init__(self) -> None:
        if self.language not in LANGUAGES:
            raise ValueError(f"unsupported language '{self.language}', expected one of {LANGUAGES}")

    def run_row(self, spark: SparkSession) -> DataFrame:
        r, v = self.result, self.validation
        row = (
            self.run_id,
            self.started_at,
            datetime.now(timezone.utc),
            self.source,
            self.target,
            r.rows_before,
            r.rows_after,
            r.rows_before - r.rows_after,
            r.columns_before,
            r.columns_after,
            v.valid,
            list(v.errors),
            list(v.warnings),
            list(r.warnings),
            self.language,
            __version__,
        )
        return spark.createDataFrame([row], RUN_SCHEMA)

    def actions(self, spark: SparkSession) -> DataFrame:
        done = {id(rule) for rule in self.plan.applied}
        rows = [
            (self.run_id, i, r.action, r.column, r.parameters_json(), r.description, r.approved, id(r) in done, r.source)
            for i, r in enumerate(self.plan.rules)
        ]
        return spark.createDataFrame(rows, ACTION_SCHEMA)

    def write(self, spark: SparkSession, base: str, format: str = "parquet") -> None:
        """Append to the three tables below ``base``, each partitioned by run."""
        tables = {
            "audit_runs": self.run_row(spark),
            "audit_actions": self.actions(spark),
            "audit_transforms": with_run(self.transforms, self.run_id),
        }
        for name, table in tables.items():
            table.write.mode("append").partitionBy("run_id").format(format).save(f"{base.rstrip('/')}/{name}")
