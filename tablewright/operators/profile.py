"""Column profiles and table statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.columns import column, count_if, data_columns, present, type_of
from tablewright.operators.values import first_per_group, value_counts
from tablewright.plans.rules import ACTIONS

SAMPLES = 3


def _column_list(df: DataFrame, names: Sequence[str]) -> DataFrame:
    rows = [(str(i), i, name, type_of(df, name).simpleString()) for i, name in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "pos string, position int, column string, dtype string")


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    order_by: str | None = None,
    approx: bool = False,
) -> DataFrame:
    """(position, column, dtype, non_null, nulls, distinct, samples), one row per column.

    ``samples`` are the first three distinct values in order of appearance. ``approx`` counts
    distinct values with a sketch in a single aggregate and gives no samples.
    """
    names = list(columns or data_columns(df))
    if approx:
        return _approx_profile(df, names)
    counts = value_counts(df, names, order_by)
    totals = counts.groupBy("pos").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("value").alias("distinct"),
    )
    samples = first_per_group(
        counts.filter(F.col("value").isNotNull()), ["pos"], ["first", "value"], SAMPLES
    ).withColumnRenamed("examples", "samples")
    zero = F.lit(0).cast("long")
    # Every side has at most one row per column of the table, so these joins stay tiny.
    return (
        _column_list(df, names)
        .join(F.broadcast(totals), "pos", "left")
        .join(F.broadcast(samples), "pos", "left")
        .select(
            "position",
            "column",
            "dtype",
            F.coalesce("non_null", zero).alias("non_null"),
            F.coalesce("nulls", zero).alias("nulls"),
            F.coalesce("distinct", zero).alias("distinct"),
            F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        )
    )


def _approx_profile(df: DataFrame, names: Sequence[str]) -> DataFrame:
    sums: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(names):
        sums.append(F.count(present(df, name)).alias(f"c{i}"))
        sums.append(F.approx_count_distinct(present(df, name)).alias(f"d{i}"))
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column"),
            F.lit(type_of(df, name).simpleString()).alias("dtype"),
            F.col(f"c{i}").alias("non_null"),
            (F.col("rows") - F.col(f"c{i}")).alias("nulls"),
            F.col(f"d{i}").alias("distinct"),
            F.array().cast("array<string>").alias("samples"),
        )
        for i, name in enumerate(names)
    ]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def profile_rollup(df: DataFrame, levels: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """(levels..., level, position, column, cells, non_null, nulls, distinct) per group, part total and total.

    ``levels`` goes from the widest group to the narrowest, such as kind of file and file. A row of
    ``level`` n is named by the first n of them, the others are null there; level 0 is the whole
    table. (A group may have a null name itself, so ``level`` tells them apart.) The table is read
    once: equal cells of a group become one row with a count before the part totals are formed.
    """
    names = [n for n in (columns or data_columns(df)) if n not in levels]
    inner = [f"_level{i}" for i in range(len(levels))]
    named = df.select("*", *[column(name).alias(alias) for name, alias in zip(levels, inner)])
    values = value_counts(named, names, by=inner)
    sets = [["pos", "value", *inner[:n]] for n in range(len(inner), -1, -1)]
    rolled = values.groupingSets(sets, "pos", "value", *inner).agg(
        F.sum("n").alias("n"), (F.lit(len(inner)) - F.bit_count(F.grouping_id())).alias("level")
    )
    filled = F.col("value").isNotNull()
    counted = rolled.groupBy("pos", "level", *inner).agg(
        F.sum("n").alias("cells"),
        F.sum(F.when(filled, F.col("n")).otherwise(0)).alias("non_null"),
        F.sum(F.when(filled, 0).otherwise(F.col("n"))).alias("nulls"),
        F.count("value").alias("distinct"),
    )
    # One row per column on this side.
    return counted.join(F.broadcast(_column_list(df, names)), "pos").select(
        *[F.col(alias).alias(name) for name, alias in zip(levels, inner)],
        F.col("level").cast("int").alias("level"), "position", "column", "cells", "non_null", "nulls", "distinct",
    )


def table_stats(df: DataFrame) -> DataFrame:
    """(row_count, column_count) as one row."""
    width = len(data_columns(df))
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "column_count", F.lit(width).cast("long")
    )


def affected_ratio(affected: Column, total: Column) -> Column:
    """Affected share rounded to four places; 0 for an empty total."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(affected / total, 4))


def issue_summary(stats: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: rows, columns, number of issues in total and by severity."""
    counted = issues.agg(
        F.count(F.lit(1)).alias("issues"),
        *[
            count_if(F.col("severity") == level.upper()).alias(f"{level}_issues")
            for level in ("high", "medium", "low")
        ],
    )
    # Both sides are single-row aggregates.
    return stats.join(F.broadcast(counted), F.lit(True))


def issues_by_severity(issues: DataFrame, severity: str) -> DataFrame:
    return issues.filter(F.col("severity") == severity)


def safe_profile(profile_df: DataFrame, issues: DataFrame, stats: DataFrame) -> DataFrame:
    """One JSON text with profile, issues and allowed actions, but without any cell value."""
    columns = profile_df.drop("samples").agg(
        F.array_sort(F.collect_list(F.struct("position", "column", "dtype", "non_null", "nulls", "distinct"))).alias("columns")
    )
    found = issues.agg(
        F.array_sort(
            F.collect_list(
                F.struct("position", "category", "column", "severity", "affected", "total", "suggested_action")
            )
        ).alias("issues")
    )
    allowed = F.array(*[F.lit(action) for action in ACTIONS]).alias("allowed_actions")
    # One row per side; the arrays hold one entry per column or issue, never per table row.
    return (
        stats.join(F.broadcast(columns), F.lit(True))
        .join(F.broadcast(found), F.lit(True))
        .select(F.to_json(F.struct("row_count", "column_count", "columns", "issues", allowed)).alias("payload"))
    )
