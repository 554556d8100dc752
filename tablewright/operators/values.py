"""Counts of distinct cell values, the shared base of profiles and spelling checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.columns import ROW_ID, column, present, type_of
from tablewright.functions.text import as_text, strip


def order_column(df: DataFrame, order_by: str | None) -> Column:
    """What "first" means: the given column, the row id, or else nothing (ties by value)."""
    if order_by:
        return column(order_by)
    return column(ROW_ID) if ROW_ID in df.columns else F.lit(0).cast("long")


def long_values(df: DataFrame, names: Sequence[str], *keep: Column, stripped: bool = False) -> DataFrame:
    """One row per cell: (kept columns..., pos, value); ``pos`` is the short column number."""
    texts = []
    for i, name in enumerate(names):
        text = as_text(present(df, name), type_of(df, name))
        texts.append((strip(text) if stripped else text).alias(str(i)))
    wide = df.select(*keep, *texts)
    ids = [F.col(f"`{c}`") for c in wide.columns[: len(keep)]]
    return wide.unpivot(ids, [F.col(f"`{i}`") for i in range(len(names))], "pos", "value")


def value_counts(
    df: DataFrame, names: Sequence[str], order_by: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """(by..., pos, value, n, first): how often each value occurs in each column, and where first.

    All columns share one unpivot and one grouping, where several distinct counts in one
    aggregate would copy every row once per column. Hot values collapse before the shuffle.
    """
    cells = long_values(df, names, *[column(b) for b in by], order_column(df, order_by).alias("first"))
    return cells.groupBy(*by, "pos", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("first").alias("first")
    )


def spelling_groups(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., pos, key, spellings, n): stripped non-blank values grouped without case."""
    cells = long_values(df, names, *[column(b) for b in by], stripped=True)
    spelled = cells.filter(F.col("value") != "").groupBy(*by, "pos", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    return spelled.groupBy(*by, "pos", F.lower("value").alias("key")).agg(
        F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n")
    )


def first_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """(groups..., examples): the first ``n`` values of each group as an array.

    The rank filter lets Spark cut each group to ``n`` rows inside every task before the shuffle.
    """
    window = Window.partitionBy(*groups).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n)
    pairs = F.array_sort(F.collect_list(F.struct("_rank", "value")))
    return ranked.groupBy(*groups).agg(F.transform(pairs, lambda p: p["value"]).alias("examples"))
