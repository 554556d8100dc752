"""Plans over streams: row-local rules, bounded duplicate removal, and new files of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablewright.columns import ROW_ID, SOURCE_FILE, column, data_columns
from tablewright.plans.plan import Plan
from tablewright.plans.rules import CELL_ACTIONS, SHAPE_ACTIONS, RuleError
from tablewright.runner import clean_table
from tablewright.sinks.publish import PublishError
from tablewright.sources.inventory import metadata_path
from tablewright.sources.text import TextFormat, describe, read_text

STREAMABLE = (*CELL_ACTIONS, *SHAPE_ACTIONS, "drop_empty_rows")


def apply_stream(
    stream: DataFrame, plan: Plan, event_time: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """The plan on a streaming table.

    Cell, shape and empty-row rules need no state. Duplicates are removed by arrival within the
    watermark, so only keep-first has a meaning; rules that must see the whole table are refused.
    """
    out = stream
    watermarked = False
    for rule in plan.applied:
        if rule.action in STREAMABLE:
            out = Plan((rule,)).apply(out)
            continue
        by_key = rule.action == "dedupe_by_key" and rule.parameters.get("keep", "first") == "first"
        if rule.action != "dedupe_exact" and not by_key:
            raise RuleError(f"{rule.action} needs the whole table and cannot run on a stream")
        if event_time is None:
            raise RuleError(f"{rule.action} on a stream needs an event time column")
        if not watermarked:
            out, watermarked = out.withWatermark(event_time, delay), True
        keys = data_columns(out)
        if by_key:
            keys = rule.parameters.get("subset_columns") or [rule.column]
        out = out.dropDuplicatesWithinWatermark(keys)
    return out


def clean_new_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    plan: Plan | Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    rejects: str | None = None,
) -> StreamingQuery:
    """Clean the files that arrived since the last call, and only those.

    The stream only finds the new files; each micro-batch reads them like any text table, so the
    separator, encoding, order of columns and line breaks are those of each file. Files whose header
    does not hold the columns of ``schema``, and rows with surplus fields or cells that are not of
    their type, go to the rejects (beside the target unless named) with the reason. A plan's result is
    published only if it agrees with its replay. The checkpoint remembers what was read. Every
    micro-batch owns one partition of the target, so a batch that is retried after a failure replaces
    its own output instead of adding to it.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    lost = (rejects or f"{target.rstrip('/')}_rejects").rstrip("/")
    found = spark.readStream.schema("value string").text(folder).select(metadata_path().alias("path"))

    def write(batch: DataFrame, number: int) -> None:
        # One record per file, like a listing.
        paths = [r.path for r in batch.distinct().collect()]
        rows, refused = new_rows(spark, paths, wanted)
        refused.write.mode("overwrite").parquet(f"{lost}/batch={number}")
        if rows is None:
            return
        if isinstance(plan, Plan):
            outcome = clean_table(rows, plan, staged=True)
            if not outcome.validation.valid:
                raise PublishError(f"batch {number} is not valid: {'; '.join(outcome.validation.errors)}")
            out = outcome.cleaned
        else:
            out = plan(rows)
        kept = out.select(*[column(n) for n in data_columns(out)])
        kept.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    return (
        found.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def new_rows(spark: SparkSession, paths: list[str], schema: T.StructType) -> tuple[DataFrame | None, DataFrame]:
    """Typed rows of the files that fit the schema, and what was refused: (source, record, reason)."""
    groups, failures = describe(spark, paths)
    names = sorted(schema.names)
    fit: dict[TextFormat, list[str]] = {}
    for fmt, files in groups.items():
        if sorted(fmt.columns) == names:
            fit[fmt] = files
        else:
            failures += [(path, f"header {list(fmt.columns)} instead of {schema.names}") for path in files]
    refused = spark.createDataFrame([(path, None, reason) for path, reason in failures], "source string, record string, reason string")
    if not fit:
        return None, refused
    good, surplus = read_text(spark, [path for files in fit.values() for path in files], any_order=True, groups=fit)
    typed = {f.name: column(f.name).try_cast(f.dataType) for f in schema.fields}
    bad = F.lit(False)
    for name, cell in typed.items():
        bad = bad | (cell.isNull() & column(name).isNotNull())
    record = F.to_json(F.struct(*[column(n) for n in schema.names]))
    wrong = good.filter(bad).select(column(SOURCE_FILE), record, F.lit("a cell is not of its type"))
    refused = refused.unionAll(surplus.select(column(SOURCE_FILE), "record", "reason")).unionAll(wrong)
    rows = good.filter(~bad).select(SOURCE_FILE, ROW_ID, *[cell.alias(name) for name, cell in typed.items()])
    return rows, refused
