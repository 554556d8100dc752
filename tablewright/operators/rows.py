"""Row rules: dropping empty rows and removing duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.columns import IDENTITY, ROW_ID, column, data_columns, quoted

_UNORDERED = (T.MapType, T.VariantType)


def drop_empty_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows that are null (or NaN) in all data columns."""
    names = list(columns or data_columns(df))
    return df.na.drop(how="all", subset=[quoted(name) for name in names])


def dedupe_exact(
    df: DataFrame, columns: Sequence[str] | None = None, scope: Sequence[str] = ()
) -> DataFrame:
    """Keep the first of rows that agree in all data columns; nulls are equal.

    A grouping with a partial aggregate: copies of one row collapse inside each task before the
    shuffle, so a row that makes up a third of the table does not become a hot partition.
    """
    names = list(columns or data_columns(df))
    keys = [*scope, *[name for name in names if name not in scope]]
    if ROW_ID not in df.columns:
        return df.dropDuplicates([name for name in keys])
    # The first row is the one with the smallest source file and row id; both stay together.
    identity = [name for name in IDENTITY if name in df.columns and name not in keys]
    # A single number can be kept in a hash table, a struct of several needs a sort of all rows.
    smallest = column(identity[0]) if len(identity) == 1 else F.struct(*[column(name) for name in identity])
    first = F.min(smallest).alias("_first")
    kept = df.groupBy(*[column(name) for name in keys]).agg(first)
    return kept.select(
        *[
            column(name) if name not in identity
            else F.col("_first" if len(identity) == 1 else f"_first.{name}").alias(name)
            for name in df.columns
        ]
    )


def row_order(
    df: DataFrame, order_by: Sequence[str] | None, descending: bool = False, keys: Sequence[str] = ()
) -> list:
    """Sort columns of "first"/"last": the row id or the given columns, then all others as ties."""
    order = list(order_by or ())
    if not order:
        if ROW_ID not in df.columns:
            raise ValueError("first/last needs a row id or order_by columns")
        order = [ROW_ID]
    if ROW_ID not in order:
        ties = [
            f.name
            for f in df.schema.fields
            if f.name not in order and f.name not in keys and not isinstance(f.dataType, _UNORDERED)
        ]
        order = [*order, *ties]
    return [column(name).desc() if descending else column(name).asc() for name in order]


def dedupe_by_key(
    df: DataFrame,
    keys: Sequence[str],
    keep: str = "first",
    order_by: Sequence[str] | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Keep the whole first or last row of each key; null keys form one group.

    Spark limits the window group to one row per key inside each task before the shuffle, so a
    hot key sends one row per task, not all its rows.
    """
    rank = "_key_rank"
    window = Window.partitionBy(*[column(name) for name in [*scope, *keys]]).orderBy(
        *row_order(df, order_by, keep == "last", keys)
    )
    ranked = df.withColumn(rank, F.row_number().over(window))
    return ranked.filter(F.col(rank) == 1).drop(rank)
