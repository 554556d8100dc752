"""Many tables of one schema cleaned together: rules per source, one job for all of them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.columns import (
    ROW_ID,
    SOURCE_FILE,
    barrier,
    column,
    count_if,
    data_columns,
    text_columns,
)
from tablewright.functions import text as cells
from tablewright.functions.dates import default_pivot_year
from tablewright.operators import rows
from tablewright.plans.plan import date_steps, number_steps, run_steps
from tablewright.plans.propose import PASSES, column_shapes, decisions

FACTS = ("outer_space", "invisibles", "mixed_case", "kind", "percent")


def source_decisions(df: DataFrame, source: str = SOURCE_FILE) -> DataFrame:
    """One row per source: the rule decisions of all its text columns, as columns fact+number.

    Written once, so that it is not found anew by each step that joins it, and so that its size is
    known when a join is planned: a small table is broadcast, and no row is dealt by its source.
    """
    from tablewright.runner import stage

    names = text_columns(df.drop(source))
    shapes = decisions(column_shapes(df, names, by=[source]))
    chosen = shapes.groupBy(column(source)).agg(
        *[
            F.max(F.when(F.col("pos") == str(i), F.col(fact))).alias(f"_{fact}{i}")
            for i in range(len(names))
            for fact in FACTS
        ]
    )
    return stage(chosen, "decisions")


def with_decisions(df: DataFrame, chosen: DataFrame, source: str) -> DataFrame:
    """Rows with the decisions of their source; Spark broadcasts them if they are small, else AQE
    splits a source that holds too many rows."""
    return df.join(chosen, source, "left")


def _needed(chosen: DataFrame, columns: int) -> dict[str, list[int]]:
    """The columns, by number, that any source decided to treat so; one row comes to the driver."""
    tests = {fact: lambda i, fact=fact: F.col(f"_{fact}{i}") for fact in ("outer_space", "invisibles", "mixed_case")}
    tests |= {kind: lambda i, kind=kind: F.col(f"_kind{i}") == kind for kind in ("date", "number")}
    found = chosen.agg(F.count(F.lit(1)), *[F.bool_or(test(i)).alias(f"{fact}{i}") for fact, test in tests.items() for i in range(columns)]).first()
    return {fact: [i for i in range(columns) if found[f"{fact}{i}"]] for fact in tests}


def clean_sources(
    df: DataFrame,
    chosen: DataFrame,
    source: str = SOURCE_FILE,
    passes: Iterable[str] = PASSES,
    pivot_year: int | None = None,
) -> DataFrame:
    """The three automatic passes, each cell under the rules of its own source.

    Sources of one schema share one plan, so a number column stays text here: another source may
    hold words in it. Duplicates are removed within a source only. A rule that no source decided on for
    a column is left out of the plan.
    """
    wanted = set(passes)
    if not wanted <= set(PASSES):
        raise ValueError(f"unknown passes {sorted(wanted - set(PASSES))}")
    names = text_columns(df.drop(source))
    fixed = [n for n in df.columns if n not in names]
    pivot = pivot_year or default_pivot_year()
    out = with_decisions(df, chosen, source)
    needed = _needed(chosen, len(names)) if wanted & {"pass1", "pass2"} else {}

    def level(step, places: Sequence[int]) -> None:
        nonlocal out
        if places:
            out = out.select(
                *[column(n) for n in fixed],
                *[step(i, column(n)).alias(n) if i in places else column(n) for i, n in enumerate(names)],
                *[c for c in out.columns if c not in df.columns],
            )

    def on(fact: str, i: int) -> Column:
        return F.col(f"_{fact}{i}")

    if "pass1" in wanted:
        level(lambda i, c: F.when(on("outer_space", i), cells.strip(c)).otherwise(c), needed["outer_space"])
        level(lambda i, c: F.when(on("invisibles", i), cells.strip_invisibles(c)).otherwise(c), needed["invisibles"])
        level(lambda i, c: F.when(on("mixed_case", i), cells.title_case(c)).otherwise(c), needed["mixed_case"])
    if "pass2" in wanted:
        # The read date and number are columns of their own, since the choice between them and
        # the text form of the number read them several times.
        for kind, steps in (
            ("date", lambda i: date_steps(True, pivot)),
            ("number", lambda i: number_steps(convert_percentages=on("percent", i))),
        ):
            out = out.select(
                "*",
                *[F.when(on("kind", i) == kind, column(names[i])).alias(f"_{kind}{i}") for i in needed[kind]],
            )
            out = run_steps(out, {f"_{kind}{i}": steps(i) for i in needed[kind]})
        read = {i: F.when(on("kind", i) == "date", F.col(f"_date{i}")) for i in needed["date"]}
        for i in needed["number"]:
            number = cells.as_text(F.col(f"_number{i}"), T.DoubleType())
            read[i] = (read[i] if i in read else F).when(on("kind", i) == "number", number)
        level(lambda i, c: read[i].otherwise(c), list(read))
    if "pass3" in wanted:
        level(lambda i, c: F.when(on("kind", i) == "date", c).otherwise(cells.blank_to_null(c)), range(len(names)))
    out = out.select(*[column(n) for n in df.columns])
    if "pass3" in wanted:
        values = [n for n in data_columns(df) if n != source]
        out = rows.drop_empty_rows(barrier(out, "rows_before_drop"), values)
        out = rows.dedupe_exact(out, values, scope=[source])
    return out


def source_differences(
    expected: DataFrame, candidate: DataFrame, source: str = SOURCE_FILE
) -> DataFrame:
    """(source, missing, extra, differing): disagreements of a candidate with its replay."""
    key = [source, ROW_ID]
    names = [n for n in data_columns(expected) if n != source]
    left = expected.select(*key, F.struct(*[column(n) for n in names]).alias("_e"))
    right = candidate.select(*key, F.struct(*[column(n) for n in names]).alias("_c"))
    both = F.col("_e").isNotNull() & F.col("_c").isNotNull()
    return left.join(right, key, "full_outer").groupBy(source).agg(
        count_if(F.col("_c").isNull()).alias("missing"),
        count_if(F.col("_e").isNull()).alias("extra"),
        count_if(both & ~F.col("_e").eqNullSafe(F.col("_c"))).alias("differing"),
    )


def source_changes(
    original: DataFrame,
    cleaned: DataFrame,
    chosen: DataFrame,
    source: str = SOURCE_FILE,
    passes: Iterable[str] = PASSES,
) -> DataFrame:
    """(source, rows_before, rows_after, rows_removed, changes, actions, result) per source.

    Every applied rule reports the changed cells of its column, and each of the two row rules the
    removed rows, next to the removal itself.
    """
    wanted = set(passes)
    key = [source, ROW_ID]
    names = text_columns(original.drop(source))
    left = original.select(*key, F.lit(True).alias("_b"), *[column(n).alias(f"b{i}") for i, n in enumerate(names)])
    right = cleaned.select(*key, F.lit(True).alias("_a"), *[column(n).alias(f"a{i}") for i, n in enumerate(names)])
    both = F.col("_b").isNotNull() & F.col("_a").isNotNull()
    counted = left.join(right, key, "full_outer").groupBy(source).agg(
        F.count("_b").alias("rows_before"),
        F.count("_a").alias("rows_after"),
        *[
            count_if(both & ~F.col(f"b{i}").eqNullSafe(F.col(f"a{i}"))).alias(f"x{i}")
            for i in range(len(names))
        ],
        *[
            count_if(both & (F.col(f"b{i}").isNotNull() | F.col(f"a{i}").isNotNull())).alias(f"v{i}")
            for i in range(len(names))
        ],
    )
    joined = with_decisions(counted, chosen, source)
    removed = F.col("rows_before") - F.col("rows_after")
    row_rules = 2 if "pass3" in wanted else 0
    changed = F.lit(0).cast("long")
    actions = F.lit(row_rules).cast("long")
    touched = F.lit(False)
    for i in range(len(names)):
        kind = F.col(f"_kind{i}")
        rules = F.lit(0).cast("long")
        if "pass1" in wanted:
            for fact in ("outer_space", "invisibles", "mixed_case"):
                rules = rules + F.col(f"_{fact}{i}").cast("long")
        if "pass2" in wanted:
            rules = rules + (kind != "text").cast("long")
        if "pass3" in wanted:
            rules = rules + (kind != "date").cast("long")
        # A text that became a number is another value, even if it reads the same.
        typed = (kind == "number") & F.lit("pass2" in wanted)
        cells_changed = F.when(typed, F.col(f"v{i}")).otherwise(F.col(f"x{i}"))
        changed = changed + rules * cells_changed
        actions = actions + rules
        touched = touched | (cells_changed > 0) | typed
    return joined.select(
        column(source),
        "rows_before",
        "rows_after",
        removed.alias("rows_removed"),
        (changed + removed * (row_rules + 1)).alias("changes"),
        actions.alias("actions"),
        F.when(touched | (removed > 0), "CLEANED").otherwise("UNCHANGED").alias("result"),
    )


def batch_summary(items: DataFrame) -> DataFrame:
    """Totals over batch items with status ok, invalid or error."""
    ok = F.col("status") == "ok"

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(ok, F.col(name))), F.lit(0)).cast("long").alias(f"total_{name}")

    return items.agg(
        F.count(F.lit(1)).alias("files_found"),
        count_if(ok).alias("processed_ok"),
        count_if(F.col("status") == "invalid").alias("processed_invalid"),
        count_if(F.col("status") == "error").alias("errors"),
        count_if(ok & (F.col("result") == "CLEANED")).alias("cleaned"),
        count_if(ok & (F.col("result") == "UNCHANGED")).alias("unchanged"),
        total("rows_before"),
        total("rows_after"),
        total("rows_removed"),
        total("changes"),
    )


def self_check(items: DataFrame, summary: DataFrame) -> DataFrame:
    """One row (consistent): do the summary's counters and totals add up again from the items?"""
    again = batch_summary(items)
    names = [n for n in again.columns if n not in ("cleaned", "unchanged")]
    left = again.select(F.struct(*names).alias("_again"))
    right = summary.select(F.struct(*names).alias("_told"))
    # Both sides are single-row aggregates.
    return left.join(F.broadcast(right), F.lit(True)).select(
        F.col("_again").eqNullSafe(F.col("_told")).alias("consistent")
    )


def error_class(reason: Column) -> Column:
    """Short class of a failure message."""
    return (
        F.when(reason.rlike("(?i)PATH_NOT_FOUND|not found|does not exist|no such file"), "not_found")
        .when(reason.rlike("(?i)permission|access denied|forbidden"), "permission")
        .otherwise("other")
    )


@dataclass(frozen=True)
class Batch:
    cleaned: DataFrame
    items: DataFrame
    summary: DataFrame
    rejects: DataFrame


def item_rows(changes: DataFrame, differences: DataFrame, source: str = SOURCE_FILE) -> DataFrame:
    """Batch items: a source whose candidate disagrees with its replay is invalid."""
    bad = (F.col("missing") + F.col("extra") + F.col("differing")) > 0
    return changes.join(differences, source, "left").select(
        column(source).alias("source"),
        F.when(bad, "invalid").otherwise("ok").alias("status"),
        "rows_before",
        "rows_after",
        "rows_removed",
        "changes",
        "actions",
        F.when(~bad | bad.isNull(), F.col("result")).alias("result"),
        F.when(
            bad,
            F.concat_ws(
                ", ",
                F.concat(F.col("missing").cast("string"), F.lit(" rows missing")),
                F.concat(F.col("extra").cast("string"), F.lit(" rows extra")),
                F.concat(F.col("differing").cast("string"), F.lit(" rows differ")),
            ),
        ).alias("reason"),
    )


ITEM_SCHEMA = (
    "source string, status string, rows_before bigint, rows_after bigint, rows_removed bigint, "
    "changes bigint, actions bigint, result string, reason string"
)


def empty_items(spark, sources: Sequence[str], items: DataFrame) -> DataFrame:
    """Items of the sources that have no row, such as files with nothing but a header."""
    rows_ = [(path, "ok", 0, 0, 0, 0, 0, "UNCHANGED", None) for path in sources]
    return spark.createDataFrame(rows_, ITEM_SCHEMA).join(items.select("source"), "source", "left_anti")


def failed_items(spark, failures: Sequence[tuple[str, str]]) -> DataFrame:
    rows_ = [(path, "error", None, None, None, None, None, None, reason) for path, reason in failures]
    return spark.createDataFrame(rows_, ITEM_SCHEMA)
