"""Batch cleaning of a folder: every readable file, one plan per kind of file, nothing half-done."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.columns import FILE_LABEL, ROW_ID, SOURCE_FILE, column, data_columns, text_columns
from tablewright.functions import constants as K
from tablewright.functions.dates import default_pivot_year
from tablewright.operators import batch as B
from tablewright.plans.propose import PASSES
from tablewright.runner import stage
from tablewright.functions.text import neutralize_formula
from tablewright.sinks.publish import PublishError, read_published, run_path, table_digest, text_options
from tablewright.sources import text, workbook
from tablewright.sources.inventory import inventory


@dataclass(frozen=True)
class FolderRun:
    run_id: str
    output: str
    items: DataFrame
    summary: DataFrame
    rejects: DataFrame
    rejected_rows: DataFrame | None


def _groups(
    spark: SparkSession, paths: Sequence[str]
) -> tuple[list[tuple[DataFrame, list[str]]], list[tuple[str, str]], list[DataFrame]]:
    """Staged tables, one per kind of file, with their text files; failures; rejected rows."""
    texts = [p for p in paths if p.lower().endswith(K.TEXT_SUFFIXES)]
    books = [p for p in paths if p.lower().endswith(K.WORKBOOK_SUFFIXES)]
    tables: list[tuple[DataFrame, list[str]]] = []
    failures: list[tuple[str, str]] = []
    rejected: list[DataFrame] = []
    if texts:
        formats, failed = text.describe(spark, texts)
        failures += failed
        for fmt, files in formats.items():
            good, bad = text.split_rejects(stage(text.scan(spark, fmt, files), "scan"), fmt)
            tables.append((good, list(files)))
            rejected.append(bad)
    if books:
        rows = stage(workbook.workbook_rows(spark, books), "workbook")
        kinds, failed = workbook.describe(rows)
        failures += failed
        for names, sheets in kinds.items():
            tables.append((workbook.table_of(rows, names, sheets), []))
    return tables, failures, rejected


def clean_folder(
    spark: SparkSession,
    folder: str | Sequence[str],
    output: str,
    passes: Iterable[str] = PASSES,
    format: str = "csv",
) -> FolderRun:
    """Clean all files below a folder (or a list of files) and publish the valid results.

    A file that cannot be read, or whose result differs from its replay, is listed with the
    reason and not published; the others go on. Inputs are never moved or changed.
    """
    run_id = uuid.uuid4().hex
    target = run_path(output, run_id)
    # One record per file.
    listed = inventory(spark, folder, exclude=[output]).orderBy("path").collect()
    failures = [(row.path, row.problem) for row in listed if row.problem]
    tables, unreadable, rejected = _groups(spark, [row.path for row in listed if not row.problem])
    failures += unreadable
    pivot = default_pivot_year()
    parts: list[DataFrame] = []
    for number, (table, files) in enumerate(tables):
        # One kind of file that fails does not end the others.
        try:
            parts.append(_clean_kind(table, files, f"{target}/kind={number}", passes, pivot, format))
        except Exception as error:
            reason = str(error).strip().split("\n")[0] or type(error).__name__
            named = files or [r[0] for r in table.select(SOURCE_FILE).distinct().collect()]
            failures += [(path, reason) for path in named]
    if failures:
        parts.append(B.failed_items(spark, failures))
    items = reduce(DataFrame.unionByName, parts) if parts else B.failed_items(spark, [])
    rejects = items.filter("status <> 'ok'").select(
        "source", "status", B.error_class(F.col("reason")).alias("error_class"), "reason"
    )
    bad_rows = reduce(DataFrame.unionByName, rejected) if rejected else None
    return FolderRun(run_id, target, items, B.batch_summary(items), rejects, bad_rows)


def _clean_kind(
    table: DataFrame, files: list[str], path: str, passes: Iterable[str], pivot: int, format: str
) -> DataFrame:
    """Cleans and publishes all files of one kind; returns their items."""
    chosen = B.source_decisions(table)
    replay = B.clean_sources(table, chosen, passes=passes, pivot_year=pivot)
    cleaned = stage(replay, "candidate")
    changes = B.source_changes(table, cleaned, chosen, passes=passes)
    items = stage(B.item_rows(changes, B.source_differences(replay, cleaned)), "items")
    empty = B.empty_items(table.sparkSession, files, items) if files else None
    _publish(cleaned, items, chosen, path, format, "pass2" in set(passes))
    if empty is not None:
        _publish_empty(cleaned, empty, path, format)
        items = items.unionByName(empty)
    return items


def _label(source: str = SOURCE_FILE):
    """The stem of a file for people, a hash of its whole path against equal names."""
    stem = F.regexp_extract(F.col(source), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.concat(stem, F.lit("-"), F.lower(F.hex(F.xxhash64(source))))


def _publish(cleaned: DataFrame, items: DataFrame, chosen: DataFrame, path: str, format: str, numbers: bool) -> None:
    """Write the rows of valid sources in file order, one directory per source, and read them back.

    Rows are dealt by ranges of source and row id, so a source is in few files and a large one is
    spread over several. In the text format, text that starts like a formula gets an apostrophe; a
    cell that the second pass turned into a number is left as it is.
    """
    valid = items.filter("status = 'ok'").select(F.col("source").alias(SOURCE_FILE))
    kept = cleaned.join(valid, SOURCE_FILE, "left_semi")
    names = [n for n in data_columns(cleaned) if n != SOURCE_FILE]
    if format == "csv":
        place = {name: i for i, name in enumerate(text_columns(cleaned.drop(SOURCE_FILE)))}

        def cell(name: str):
            if name not in place:
                return column(name)
            number = (F.col(f"_kind{place[name]}") == "number") if numbers else F.lit(False)
            return F.when(F.coalesce(number, F.lit(False)), column(name)).otherwise(neutralize_formula(column(name)))

        kept = B.with_decisions(kept, chosen, SOURCE_FILE).select(SOURCE_FILE, ROW_ID, *[cell(n).alias(n) for n in names])
    dealt = kept.withColumn(FILE_LABEL, _label()).repartitionByRange(FILE_LABEL, ROW_ID).sortWithinPartitions(FILE_LABEL, ROW_ID)
    out = stage(dealt.drop(SOURCE_FILE, ROW_ID), "published").select(*[column(n) for n in names], FILE_LABEL)
    writer = out.write.mode("errorifexists").partitionBy(FILE_LABEL)
    if format == "csv":
        writer = text_options(writer, len(names))
    writer.format(format).save(path)
    found = read_published(out.sparkSession, path, format, out.schema) if not out.isEmpty() else out
    if table_digest(found.select(out.columns), format) != table_digest(out, format):
        raise PublishError(f"{path} differs from what was to be written")


def _publish_empty(cleaned: DataFrame, empty: DataFrame, path: str, format: str) -> None:
    """A file with its header for each source without rows."""
    names = [n for n in data_columns(cleaned) if n != SOURCE_FILE]
    nothing = cleaned.select(*[column(n) for n in names]).limit(0)
    for row in empty.select(_label("source").alias("label")).collect():
        writer = nothing.write.mode("errorifexists")
        if format == "csv":
            writer = text_options(writer, len(names))
        writer.format(format).save(f"{path}/{FILE_LABEL}={row.label}")
