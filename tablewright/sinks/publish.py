"""Publishing: nothing is written unless the result is valid, and what was written is checked."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.columns import IDENTITY, column, data_columns, is_text
from tablewright.functions.text import neutralize_formula
from tablewright.operators.validate import ValidationResult

FORMATS = ("parquet", "csv", "json", "orc")


class PublishError(ValueError):
    """The result may not or could not be published."""


@dataclass(frozen=True)
class PublishResult:
    path: str
    format: str
    rows: int
    columns: int


def neutralize_formulas(df: DataFrame) -> DataFrame:
    """Copy for spreadsheets: text that starts like a formula gets a leading apostrophe."""
    return df.select(
        *[
            neutralize_formula(column(n)).alias(n) if is_text(df, n) else column(n)
            for n in df.columns
        ]
    )


def without_identity(df: DataFrame) -> DataFrame:
    return df.select(*[column(n) for n in data_columns(df)])


def text_options(writer: DataFrameWriter, columns: int) -> DataFrameWriter:
    """Options under which every cell comes back as it is: outer spaces stay, nulls are empty fields.

    In a table of one column all fields are quoted, because a reader skips lines without content.
    """
    return (
        writer.option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("quoteAll", columns == 1)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def read_published(spark, path: str, format: str, schema) -> DataFrame:
    reader = spark.read.schema(schema)
    if format == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
        reader = reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return reader.format(format).load(path)


def table_digest(df: DataFrame, format: str) -> tuple:
    """Number of rows and an order-free digest of all cells.

    In the text format a null and the empty text are the same; complex and binary cells, which no
    text file holds exactly, are left out there.
    """
    cells: list[Column] = []
    for field in df.schema.fields:
        cell = column(field.name)
        if isinstance(field.dataType, T.StringType) and format == "csv":
            cells.append(F.coalesce(cell, F.lit("")))
        elif isinstance(field.dataType, (T.StringType, T.NumericType, T.BooleanType, T.DateType)):
            cells.append(cell.cast("string"))
        elif format in ("parquet", "orc") and isinstance(field.dataType, (T.TimestampType, T.BinaryType)):
            cells.append(cell)
    hashed = F.sum(F.xxhash64(F.lit(0), *cells).cast("decimal(38,0)"))
    return tuple(df.agg(F.count("*"), hashed).first())


def _move(spark, source: str, target: str) -> None:
    """Puts a written and verified folder in the place of the old one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old, new = path(target), path(source)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old):
        fs.delete(old, True)
    fs.mkdirs(old.getParent())
    if not fs.rename(new, old):
        raise PublishError(f"{source} is complete but could not be moved to {target}")


def _exists(spark, target: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def publish(
    df: DataFrame,
    path: str,
    validation: ValidationResult,
    format: str = "parquet",
    overwrite: bool = False,
) -> PublishResult:
    """Write a validated table beside its target, read it back, and only then put it in place.

    All cells are compared with what was to be written, so a target that is replaced stays as it was
    until its successor is known to be right. The text format writes UTF-8 with a header and nulls as
    empty fields, with formulas neutralised in the written copy only.
    """
    if not validation.valid:
        raise PublishError(f"not published, validation failed: {'; '.join(validation.errors)}")
    if format not in FORMATS:
        raise PublishError(f"unknown format '{format}', expected one of {FORMATS}")
    if not path or not path.strip():
        raise PublishError("a target path is required")
    spark = df.sparkSession
    out = without_identity(df)
    if not out.columns:
        raise PublishError("the table has no columns")
    if any(name in IDENTITY for name in out.columns):
        raise PublishError("identity columns may not be published")
    if not overwrite and _exists(spark, path):
        raise PublishError(f"{path} exists and overwrite is off")
    written = neutralize_formulas(out) if format == "csv" else out
    expected = table_digest(written, format)
    beside = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"
    writer = written.write.mode("errorifexists")
    if format == "csv":
        writer = text_options(writer, len(out.columns))
    writer.format(format).save(beside)
    found = table_digest(read_published(spark, beside, format, out.schema), format)
    if found != expected:
        raise PublishError(f"{beside} holds {found[0]} rows, expected {expected[0]}, or other cells; {path} is unchanged")
    _move(spark, beside, path)
    return PublishResult(path, format, found[0], len(out.columns))


def run_path(base: str, run_id: str) -> str:
    """Target of one run; a new run never touches the output of another."""
    return f"{base.rstrip('/')}/run_id={run_id}"


def with_run(df: DataFrame, run_id: str) -> DataFrame:
    return df.withColumn("run_id", F.lit(run_id))
