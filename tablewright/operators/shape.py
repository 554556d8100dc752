"""Rules that change the columns of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.columns import column, data_columns, present, type_of
from tablewright.functions import text as cells


def empty_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Names of columns without any value; one aggregate over the table."""
    names = list(columns or data_columns(df))
    counts = df.agg(*[F.count(present(df, name)).alias(f"c{i}") for i, name in enumerate(names)])
    row = counts.first()
    return [name for i, name in enumerate(names) if row[f"c{i}"] == 0]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns that are null in all rows (runs one aggregate, since the schema depends on it)."""
    gone = set(empty_columns(df))
    return df.select(*[column(name) for name in df.columns if name not in gone])


def split_column(
    df: DataFrame, name: str, delimiter: str, new_column_names: Sequence[str]
) -> DataFrame:
    """New columns take the place of the source, which stays only if its name is used again."""
    parts = "_split_parts"
    # The array is a column of its own so that the text is split once, not once per part.
    source = df.withColumn(
        parts, cells.split_parts(cells.as_text(column(name), type_of(df, name)), delimiter)
    )
    out: list[Column] = []
    for existing in df.columns:
        if existing == name:
            out.extend(
                cells.strip(F.get(F.col(parts), F.lit(i))).alias(new)
                for i, new in enumerate(new_column_names)
            )
        else:
            out.append(column(existing))
    return source.select(*out)


def rename_column(df: DataFrame, name: str, new_name: str) -> DataFrame:
    """The column keeps its place under another name."""
    return df.select(*[column(n).alias(new_name) if n == name else column(n) for n in df.columns])


def extra_parts(df: DataFrame, name: str, delimiter: str, kept: int) -> Column:
    """True where a split would silently drop parts."""
    text = cells.as_text(column(name), type_of(df, name))
    return F.size(cells.split_parts(text, delimiter)) > kept


def merge_columns(
    df: DataFrame,
    source_columns: Sequence[str],
    new_column_name: str,
    separator: str = " ",
    drop_source_columns: bool = False,
) -> DataFrame:
    """Joined text in front of the first source, or in place if it reuses a source's name."""
    merged = cells.merge_texts(
        [cells.as_text(present(df, name), type_of(df, name)) for name in source_columns], separator
    ).alias(new_column_name)
    in_place = new_column_name in df.columns
    out: list[Column] = []
    for existing in df.columns:
        if in_place and existing == new_column_name:
            out.append(merged)
            continue
        if not in_place and existing == source_columns[0]:
            out.append(merged)
        if not (drop_source_columns and existing in source_columns):
            out.append(column(existing))
    return df.select(*out)
