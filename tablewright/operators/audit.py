"""Audit metrics: what each applied rule changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.columns import IDENTITY, column, count_if, data_columns, present, type_of
from tablewright.plans.plan import Plan
from tablewright.plans.rules import Rule

GLOBAL = "GLOBAL"
TRANSFORM_SCHEMA = (
    "position int, action string, column string, parameters string, input_type string, "
    "output_type string, nulls_before bigint, nulls_after bigint, values_changed bigint, summary string"
)


class _Metrics:
    """Collects the sums the audit rows need, so that one aggregate over one join serves all."""

    def __init__(self, original: DataFrame, cleaned: DataFrame, key: Sequence[str]):
        self.original, self.cleaned, self.key = original, cleaned, list(key)
        self.sums: dict[str, Column] = {}
        self.before = {n: f"b{i}" for i, n in enumerate(data_columns(original))}
        self.after = {n: f"a{i}" for i, n in enumerate(data_columns(cleaned))}
        left = original.select(
            *[column(k) for k in key],
            F.lit(True).alias("_b"),
            *[present(original, n).alias(alias) for n, alias in self.before.items()],
        )
        right = cleaned.select(
            *[column(k) for k in key],
            F.lit(True).alias("_a"),
            *[present(cleaned, n).alias(alias) for n, alias in self.after.items()],
        )
        self.joined = left.join(right, self.key, "full_outer")

    def _sum(self, name: str, value: Column) -> Column:
        self.sums[name] = value
        return F.col(name)

    def rows_before(self) -> Column:
        return self._sum("rows_before", F.count("_b"))

    def rows_after(self) -> Column:
        return self._sum("rows_after", F.count("_a"))

    def nulls_before(self, name: str) -> Column:
        alias = self.before[name]
        return self._sum(f"n{alias}", F.count("_b") - F.count(alias))

    def nulls_after(self, name: str) -> Column:
        alias = self.after[name]
        return self._sum(f"n{alias}", F.count("_a") - F.count(alias))

    def all_nulls(self, before: bool) -> Column:
        names = self.before if before else self.after
        one = self.nulls_before if before else self.nulls_after
        total = F.lit(0).cast("long")
        for name in names:
            total = total + one(name)
        return total

    def changed(self, name: str) -> Column:
        before, after = F.col(self.before[name]), F.col(self.after[name])
        both = F.col("_b").isNotNull() & F.col("_a").isNotNull()
        if type_of(self.original, name) == type_of(self.cleaned, name):
            differs = ~before.eqNullSafe(after)
        else:
            # A value of another type is another value; only null stays null.
            differs = before.isNotNull() | after.isNotNull()
        return self._sum(f"x{self.before[name]}", count_if(both & differs))

    def run(self) -> DataFrame:
        return self.joined.agg(*[value.alias(name) for name, value in self.sums.items()])


def _number(value: Column) -> Column:
    return value.cast("string")


def _column_summary(changed: Column, before: Column, after: Column) -> Column:
    parts = F.array_compact(
        F.array(
            F.when(after > before, F.concat(F.lit("nulls: +"), _number(after - before))),
            F.when(changed > 0, F.concat(F.lit("changed: "), _number(changed))),
            F.when(after < before, F.concat(F.lit("nulls: -"), _number(before - after))),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("no visible change")


def _entry(m: _Metrics, position: int, rule: Rule) -> Column | None:
    types_in = {n: type_of(m.original, n).simpleString() for n in m.before}
    types_out = {n: type_of(m.cleaned, n).simpleString() for n in m.after}
    parameters = rule.parameters
    zero = F.lit(0).cast("long")
    name, before, after, changed = rule.column, zero, zero, zero
    kind_in, kind_out, summary = "-", "-", F.lit("")

    if rule.action == "split_column":
        if name not in m.before:
            return None
        first = parameters["new_column_names"][0]
        kind_in, kind_out = types_in[name], types_out.get(first, "-")
        before, changed = m.nulls_before(name), m.rows_before()
        after = m.nulls_after(first) if first in m.after else zero
        summary = F.lit(f"split on {parameters['delimiter']!r} into {parameters['new_column_names']}")
    elif rule.action == "rename_column":
        new = parameters["new_name"]
        if name not in m.before or new not in m.after:
            return None
        kind_in, kind_out = types_in[name], types_out[new]
        before, after = m.nulls_before(name), m.nulls_after(new)
        summary = F.lit(f"renamed to {new!r}")
    elif rule.action == "merge_columns":
        name, sources = parameters["new_column_name"], parameters["source_columns"]
        if name not in m.after:
            return None
        kind_in = "+".join(types_in[s] for s in sources if s in types_in) or "-"
        kind_out = types_out[name]
        before = m.nulls_before(sources[0]) if sources[0] in m.before else zero
        after, changed = m.nulls_after(name), m.rows_after()
        dropped = " and dropped the sources" if parameters.get("drop_source_columns") else ""
        summary = F.lit(f"joined {sources} with {parameters.get('separator', ' ')!r}{dropped}")
    elif rule.action == "dedupe_by_key" or rule.column is None:
        name = GLOBAL
        rows_in, rows_out = m.rows_before(), m.rows_after()
        before, after, changed = m.all_nulls(True), m.all_nulls(False), rows_in - rows_out
        kind_in, kind_out = f"table of {len(m.before)} columns", f"table of {len(m.after)} columns"
        if rule.action == "dedupe_by_key":
            keys = parameters.get("subset_columns") or [rule.column]
            summary = F.lit(f"kept the {parameters.get('keep', 'first')} row per {keys}")
        else:
            summary = F.concat(
                F.lit("rows: "), _number(rows_in), F.lit(" to "), _number(rows_out),
                F.lit(" (removed "), _number(changed), F.lit(")"),
            )
    else:
        if name not in m.before or name not in m.after:
            return None
        kind_in, kind_out = types_in[name], types_out[name]
        before, after = m.nulls_before(name), m.nulls_after(name)
        if rule.action == "junk_to_null":
            changed = F.greatest(zero, after - before)
            extra = parameters.get("extra_patterns") or []
            zeros = " and zeros" if parameters.get("convert_text_zeros") else ""
            summary = F.lit("listed placeholders" + zeros + (f" and {extra}" if extra else "") + " to null")
        else:
            changed = m.changed(name)
            summary = _column_summary(changed, before, after)
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(rule.action).alias("action"),
        F.lit(name).alias("column"),
        F.lit(rule.parameters_json()).alias("parameters"),
        F.lit(kind_in).alias("input_type"),
        F.lit(kind_out).alias("output_type"),
        before.alias("nulls_before"),
        after.alias("nulls_after"),
        changed.alias("values_changed"),
        summary.alias("summary"),
    )


def transforms(
    plan: Plan, original: DataFrame, cleaned: DataFrame, key: Sequence[str] | None = None
) -> DataFrame:
    """One row per applied rule; cells are compared by row key, so removed rows shift nothing.

    The key is the source file, where there is one, and the row id.
    """
    key = list(key or [name for name in IDENTITY if name in original.columns and name in cleaned.columns])
    metrics = _Metrics(original, cleaned, key)
    entries = [
        entry
        for position, rule in enumerate(plan.applied)
        if (entry := _entry(metrics, position, rule)) is not None
    ]
    if not entries:
        return original.sparkSession.createDataFrame([], TRANSFORM_SCHEMA)
    metrics.rows_before(), metrics.rows_after()
    return metrics.run().select(F.inline(F.array(*entries)))


def total_changes(transforms_df: DataFrame, rows_removed: int = 0) -> DataFrame:
    """(changes): values changed over all applied rules, plus the rows removed in between."""
    return transforms_df.agg(
        (F.coalesce(F.sum("values_changed"), F.lit(0)) + rows_removed).cast("long").alias("changes")
    )
