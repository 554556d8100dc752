"""Column helpers shared by all operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identity columns: never part of an "all columns" rule.
ROW_ID = "_row_id"
SOURCE_FILE = "_source_file"
IDENTITY = (SOURCE_FILE, ROW_ID)
# Column of malformed records while a text file is read, and the partition of a published folder.
CORRUPT = "_corrupt"
FILE_LABEL = "_file"
RESERVED = (*IDENTITY, CORRUPT, FILE_LABEL)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """Reference to a column whose name may hold dots or backticks."""
    return F.col(quoted(name))


def data_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if name not in IDENTITY]


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), T.StringType)


def is_number(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), T.NumericType)


def text_columns(df: DataFrame) -> list[str]:
    return [name for name in data_columns(df) if is_text(df, name)]


def number_columns(df: DataFrame) -> list[str]:
    return [name for name in data_columns(df) if is_number(df, name)]


def present(df: DataFrame, name: str) -> Column:
    """The cell with NaN read as null, so that counts see one kind of missing."""
    cell = column(name)
    if isinstance(type_of(df, name), (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(cell), cell)
    return cell


def count_if(condition: Column) -> Column:
    """Number of rows where the condition is true, evaluating it once per row.

    ``F.count_if`` compares the condition with false first and so evaluates it twice.
    """
    return F.count(F.when(condition, 1))


def barrier(df: DataFrame, label: str) -> DataFrame:
    """Keep later filters above the expressions computed so far.

    Spark would otherwise push such a filter below the projections by copying their expressions
    into it, level by level, and evaluate every cell rule several times.
    """
    return df.observe(f"{label}_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))
