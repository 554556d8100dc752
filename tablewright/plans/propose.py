"""From issues and column shapes to proposed rules, and the three-pass pipeline."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tablewright.columns import column, count_if, text_columns
from tablewright.functions import constants as K
from tablewright.functions import text as cells
from tablewright.functions.dates import date_text, date_value, default_pivot_year, year_first
from tablewright.functions.numbers import is_number, probe_text
from tablewright.operators.values import value_counts
from tablewright.plans import rules as R
from tablewright.plans.plan import Plan
from tablewright.plans.rules import Rule, RuleError

PASSES = ("pass1", "pass2", "pass3")
DATE_SHARE = 0.8
NUMBER_SHARE = 0.8
PERCENT_SHARE = 0.8


def rules_from_issues(issues: DataFrame) -> Plan:
    """Every issue with a suggested action becomes an unapproved rule (one row per issue)."""
    found = issues.select("position", "suggested_action", "column", "description").orderBy("position")
    return Plan(
        tuple(
            Rule(row.suggested_action, row.column, {}, row.description, False, "analyzer")
            for row in found.toLocalIterator()
            if row.suggested_action
        )
    )


FLAGS = ("outer_space", "invisibles", "evidence")
COUNTS = ("filled", "dates", "numbers", "percents")


def column_shapes(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., pos, outer_space, invisibles, evidence, filled, dates, numbers, percents, mixed_case).

    The facts that decide the automatic rules, per text column and per group of ``by`` (such as
    the source file). The table is read once: equal cells of a column become one row with a count,
    and each different value is judged once, by one expression for all columns. Spellings of one
    text meet by 128-bit hashes, so no text is shuffled a second time.
    """
    names = list(columns or text_columns(df))
    keys = [*[column(b) for b in by], F.col("pos")]
    spelling = [F.xxhash64(F.lit(seed), "_text").alias(f"_text{seed}") for seed in (0, 1)]
    caseless = [F.xxhash64(F.lit(seed), F.lower("_text")).alias(f"_key{seed}") for seed in (0, 1)]
    judged = _judged(value_counts(df, names, by=by)).select(*keys, "n", *FLAGS, *COUNTS, *spelling, *caseless)
    texts = judged.groupBy(*keys, "_key0", "_key1").agg(
        *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in FLAGS],
        *[F.sum(F.when(F.col(f), F.col("n")).otherwise(0)).alias(f) for f in COUNTS],
        *[(F.min(f"_text{seed}") != F.max(f"_text{seed}")).alias(f"_differ{seed}") for seed in (0, 1)],
    )
    filled = F.col("filled") > 0
    found = texts.groupBy(*keys).agg(
        *[F.bool_or(f).alias(f) for f in FLAGS],
        *[F.sum(f).alias(f) for f in COUNTS],
        (
            (count_if(filled & (F.col("_differ0") | F.col("_differ1"))) > 0) & (count_if(filled) > 1)
        ).alias("mixed_case"),
    )
    if by:
        return found
    # A table without rows has its columns all the same; one row per column on both sides.
    every = df.sparkSession.createDataFrame([(str(i),) for i in range(len(names))], "pos string")
    zero = {**{f: False for f in (*FLAGS, "mixed_case")}, **{f: 0 for f in COUNTS}}
    return every.join(F.broadcast(found), "pos", "left").fillna(zero)


def _judged(values: DataFrame) -> DataFrame:
    """The facts of each different value; steps that are read twice are projected first."""
    raw, text = F.col("value"), F.col("_text")
    filled = F.coalesce(text != "", F.lit(False))
    values = values.withColumn("_text", cells.strip(raw))
    values = values.withColumn("_plain", date_text(text))
    values = values.withColumn("_ordered", year_first(F.col("_plain"), True, default_pivot_year(), True))
    return values.select(
        "*",
        (raw != text).alias("outer_space"),
        raw.rlike(K.INVISIBLE_EVIDENCE).alias("invisibles"),
        (filled & raw.rlike(K.NUMBER_EVIDENCE)).alias("evidence"),
        filled.alias("filled"),
        (filled & date_value(text, F.col("_plain"), F.col("_ordered"), True).isNotNull()).alias("dates"),
        (filled & is_number(probe_text(text))).alias("numbers"),
        (filled & raw.endswith("%")).alias("percents"),
    )


def decisions(shapes: DataFrame) -> DataFrame:
    """Add the decision per column: kind ('date', 'number' or 'text') and percent handling."""
    # Null for a column without text: no share, no decision.
    filled = F.nullif(F.col("filled"), F.lit(0))
    dates = (F.col("dates") / filled >= DATE_SHARE) & (F.col("dates") > 0)
    all_percent = F.col("percents") / filled >= PERCENT_SHARE
    numbers = (
        (F.col("numbers") / filled >= NUMBER_SHARE)
        & F.col("evidence")
        & ((F.col("percents") == 0) | all_percent)
    )
    return shapes.withColumn(
        "kind", F.when(dates, "date").when(numbers, "number").otherwise("text")
    ).withColumn("percent", F.coalesce(numbers & all_percent, F.lit(False)))


def propose(df: DataFrame) -> Pipeline:
    """Conservative rules for the three passes, all decided on the raw data."""
    names = text_columns(df)
    shapes: list[Row] = []
    if names:
        # One row per text column.
        shapes = decisions(column_shapes(df, names)).collect()
    return pipeline_from_shapes(names, shapes)


def pipeline_from_shapes(names: Sequence[str], shapes: Iterable[Row]) -> Pipeline:
    by_place = {int(row.pos): row for row in shapes}
    one: list[Rule] = []
    two: list[Rule] = []
    three: list[Rule] = [R.drop_empty_rows()]
    for i, name in enumerate(names):
        shape = by_place[i]
        if shape.outer_space:
            one.append(R.trim_text(name))
        if shape.invisibles:
            one.append(R.strip_invisibles(name))
        if shape.mixed_case:
            one.append(R.normalize_case(name, "title"))
        if shape.kind == "date":
            two.append(R.normalize_dates(name, dayfirst=True))
            continue
        if shape.kind == "number":
            two.append(R.normalize_numbers(name, convert_percentages=bool(shape.percent)))
        three.append(R.blank_to_null(name))
    three.append(R.dedupe_exact())
    return Pipeline(
        {
            key: Plan(tuple(replace(rule, approved=True, source="auto") for rule in rules))
            for key, rules in zip(PASSES, (one, two, three))
        }
    )


@dataclass(frozen=True)
class Pipeline:
    """Plans for the structural, typing and consolidation pass, run in that order."""

    passes: dict[str, Plan]

    def __post_init__(self) -> None:
        if not self.passes or not set(self.passes) <= set(PASSES):
            raise RuleError(f"passes must be a non-empty choice of {PASSES}, not {sorted(self.passes)}")

    def enable(self, names: Iterable[str]) -> Pipeline | None:
        """Pipeline restricted to the given passes; None means an explicit no-op."""
        wanted = set(names)
        if not wanted <= set(PASSES):
            raise RuleError(f"unknown passes {sorted(wanted - set(PASSES))}")
        kept = {key: plan for key, plan in self.passes.items() if key in wanted}
        return Pipeline(kept) if kept else None

    def plan(self) -> Plan:
        return reduce(Plan.__add__, [self.passes.get(key, Plan()) for key in PASSES])

    def apply(
        self, df: DataFrame, order_by: Sequence[str] | None = None, scope: Sequence[str] = ()
    ) -> DataFrame:
        return self.plan().apply(df, order_by, scope)

    def row_counts(self, df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
        """(pass, rows_before, rows_after, columns_before, columns_after) per pass with rules."""
        parts = []
        current = df
        for key in PASSES:
            plan = self.passes.get(key)
            if not plan or not plan.rules:
                continue
            after = plan.apply(current, order_by)
            before = current.agg(F.count(F.lit(1)).alias("rows_before"))
            counted = after.agg(F.count(F.lit(1)).alias("rows_after"))
            # Single-row aggregates on both sides.
            parts.append(
                before.join(F.broadcast(counted), F.lit(True)).select(
                    F.lit(key).alias("pass"),
                    "rows_before",
                    "rows_after",
                    F.lit(len(current.columns)).alias("columns_before"),
                    F.lit(len(after.columns)).alias("columns_after"),
                )
            )
            current = after
        return reduce(DataFrame.unionByName, parts)

    def loss_counts(self, df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
        """Losses of every pass, each named by its pass."""
        parts = []
        for key in PASSES:
            plan = self.passes.get(key)
            if plan:
                parts.append(plan.loss_counts(df, order_by).withColumn("pass", F.lit(key)))
                df = plan.apply(df, order_by)
        return reduce(DataFrame.unionByName, parts)
