"""A plan: an ordered list of rules, applied as one lazy DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.columns import barrier, column, count_if, data_columns, type_of
from tablewright.functions import dates, numbers, text
from tablewright.operators import rows, shape
from tablewright.plans.rules import (
    CELL_ACTIONS,
    CUSTOM,
    LOSSY_ACTIONS,
    ROW_ACTIONS,
    WITHOUT_PARAMETERS,
    Rule,
    RuleError,
    check,
)


def cell_steps(rule: Rule, data_type: T.DataType) -> list[Callable[..., Column]]:
    """The cell rule as steps; each gets the cell and the results of the steps before it.

    A step whose result is read several times becomes a column of its own, so that neither the
    plan nor the generated code repeats it. Rules for text leave columns of other types alone.
    """
    parameters = {} if rule.action in WITHOUT_PARAMETERS else dict(rule.parameters)
    textual = isinstance(data_type, T.StringType)
    if rule.action == "custom":
        return [CUSTOM[parameters["name"]]]
    if rule.action == "normalize_dates":
        if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return [lambda cell: F.date_format(cell, "yyyy-MM-dd")]
        return date_steps(**parameters)
    if rule.action == "normalize_numbers" and not textual:
        return [lambda cell: F.nullif(cell.cast("double"), F.lit(float("nan")))]
    if not textual:
        return [lambda cell: cell]
    if rule.action == "normalize_numbers":
        return number_steps(**parameters)
    if rule.action == "to_numeric_strict":
        return strict_steps(rule.column)
    functions = {
        "trim_text": text.trim_text,
        "blank_to_null": text.blank_to_null,
        "junk_to_null": text.junk_to_null,
        "normalize_case": text.normalize_case,
        "replace_values": text.replace_values,
        "strip_invisibles": text.strip_invisibles,
    }
    return [lambda cell: functions[rule.action](cell, **parameters)]


def date_steps(
    dayfirst: bool = True, pivot_year: int | None = None, allow_time: bool = False
) -> list[Callable[..., Column]]:
    pivot = pivot_year or dates.default_pivot_year()
    return [
        lambda cell: dates.date_text(cell.cast("string")),
        lambda cell, plain: dates.year_first(plain, dayfirst, pivot, allow_time),
        lambda cell, plain, ordered: F.date_format(
            dates.date_value(cell.cast("string"), plain, ordered, allow_time), "yyyy-MM-dd"
        ),
    ]


def number_steps(
    locale: str = "auto",
    remove_currency: bool = True,
    handle_parentheses_negatives: bool = True,
    convert_percentages: bool | Column = False,
) -> list[Callable[..., Column]]:
    signed = handle_parentheses_negatives
    return [
        lambda cell: numbers.number_text(cell, remove_currency, signed),
        lambda cell, plain: numbers.number_value(cell, plain, locale, signed, convert_percentages),
    ]


def strict_steps(name: str) -> list[Callable[..., Column]]:
    return [numbers.parse_strict, lambda cell, parsed: numbers.guard_strict(cell, parsed, name)]


def run_steps(df: DataFrame, steps: dict[str, list[Callable[..., Column]]]) -> DataFrame:
    """Replace each named column by the result of its last step; earlier steps are projected first."""
    known = df.columns
    position = {name: i for i, name in enumerate(known)}

    def made(name: str, count: int) -> list[Column]:
        return [column(name), *[F.col(f"_step{k}_{position[name]}") for k in range(count)]]

    depth = max((len(chain) for chain in steps.values()), default=1)
    for k in range(depth - 1):
        early = {n: chain for n, chain in steps.items() if k < len(chain) - 1}
        df = df.select(
            "*", *[chain[k](*made(n, k)).alias(f"_step{k}_{position[n]}") for n, chain in early.items()]
        )
    return df.select(
        *[
            steps[n][-1](*made(n, len(steps[n]) - 1)).alias(n) if n in steps else column(n)
            for n in known
        ]
    )


def apply_cell_rules(
    df: DataFrame, rules: Sequence[Rule], flags: dict[str, Rule] | None = None
) -> DataFrame:
    """Apply cell rules in as few projections as their order allows.

    Rules on different columns share a projection; only a second rule on the same column needs
    another one. If ``flags`` is given, a 0/1 column per lossy rule tells where it nulled a value.
    """
    waiting = list(rules)
    while waiting:
        level: dict[str, Rule] = {}
        later: list[Rule] = []
        for rule in waiting:
            check(rule, data_columns(df))
            if rule.column in level:
                later.append(rule)
            else:
                level[rule.column] = rule
        traced = {}
        if flags is not None:
            traced = {n: r for n, r in level.items() if r.action in LOSSY_ACTIONS}
        before = {name: f"_before_{len(flags) + i}" for i, name in enumerate(traced)} if traced else {}
        known = df.columns
        if before:
            df = df.select("*", *[column(name).isNotNull().alias(alias) for name, alias in before.items()])
        df = run_steps(df, {name: cell_steps(rule, type_of(df, name)) for name, rule in level.items()})
        if before:
            lost = {name: f"_lost_{len(flags) + i}" for i, name in enumerate(traced)}
            df = df.select(
                *[column(name) for name in known],
                *[
                    (F.col(before[name]) & column(name).isNull()).cast("long").alias(alias)
                    for name, alias in lost.items()
                ],
            )
            flags.update({alias: traced[name] for name, alias in lost.items()})
        waiting = later
    return df


@dataclass(frozen=True)
class Plan:
    """Rules in the order they run. Unapproved rules are kept but never applied."""

    rules: tuple[Rule, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "rules", tuple(self.rules))

    def __add__(self, other: Plan) -> Plan:
        return Plan((*self.rules, *other.rules))

    def approve(self, which: Callable[[Rule], bool] | Iterable[int] | None = None, approved: bool = True) -> Plan:
        """Plan with the chosen rules (all, by position, or by predicate) approved or withdrawn."""
        if which is None:
            chosen = lambda i, rule: True
        elif callable(which):
            chosen = lambda i, rule: which(rule)
        else:
            positions = set(which)
            chosen = lambda i, rule: i in positions
        return Plan(
            tuple(r.approve(approved) if chosen(i, r) else r for i, r in enumerate(self.rules))
        )

    @property
    def approved(self) -> tuple[Rule, ...]:
        return tuple(rule for rule in self.rules if rule.approved)

    @property
    def applied(self) -> tuple[Rule, ...]:
        """Approved rules that change data (a review flag does not)."""
        return tuple(rule for rule in self.approved if rule.action != "flag_for_review")

    def to_json(self) -> str:
        return json.dumps([rule.to_dict() for rule in self.rules], ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Plan:
        """Plan from its JSON; every rule is checked again on load."""
        return cls(tuple(check(Rule.from_dict(item)) for item in json.loads(text)))

    def warnings(self, df: DataFrame | None = None) -> list[str]:
        """Notes that need no data: ignored parameters, rules without effect, skipped reviews."""
        notes = []
        types = {} if df is None else {f.name: f.dataType for f in df.schema.fields}
        for rule in self.approved:
            if rule.parameters and rule.action in WITHOUT_PARAMETERS:
                notes.append(f"{rule.action} ignores its parameters")
            if rule.action == "flag_for_review":
                notes.append(f"review of column '{rule.column or 'N/A'}' was left to a person")
            if rule.action in ("junk_to_null", "replace_values") and rule.column in types:
                if not isinstance(types[rule.column], T.StringType):
                    notes.append(f"{rule.action}: column '{rule.column}' is not text; no effect")
        return notes

    def steps(self) -> list[list[Rule]]:
        """Maximal runs of cell rules, and every other rule as a run of its own.

        The order between runs is part of the contract (trim then dedupe differs from dedupe then
        trim), so nothing moves across a run boundary.
        """
        runs: list[list[Rule]] = []
        for rule in self.applied:
            if rule.action in CELL_ACTIONS and runs and runs[-1][0].action in CELL_ACTIONS:
                runs[-1].append(rule)
            else:
                runs.append([rule])
        return runs

    def apply(
        self, df: DataFrame, order_by: Sequence[str] | None = None, scope: Sequence[str] = ()
    ) -> DataFrame:
        """The cleaned table as a lazy DataFrame.

        ``order_by`` names the columns that define first and last where no row id exists;
        ``scope`` names columns (such as the source file) that split the input into separate
        tables for duplicate removal.
        """
        cells_changed = False
        for run in self.steps():
            if cells_changed and run[0].action == "drop_empty_rows":
                df = barrier(df, "rows_before_drop")
            df = _apply_run(df, run, order_by, scope)
            cells_changed = cells_changed or run[0].action not in ROW_ACTIONS
        return df

    def check_strict(self, df: DataFrame, order_by: Sequence[str] | None = None) -> None:
        """Raise before any write if a strict conversion would lose a value, naming one."""
        for run in self.steps():
            if any(rule.action == "to_numeric_strict" for rule in run):
                _check_run(df, run)
            df = _apply_run(df, run, order_by, ())

    def loss_counts(
        self, df: DataFrame, order_by: Sequence[str] | None = None, scope: Sequence[str] = ()
    ) -> DataFrame:
        """Values nulled by each lossy rule and parts dropped by each split, counted where it runs.

        One aggregate per run of rules; rows removed by a later rule still count.
        """
        return self._apply_counted(df, None, order_by, scope)[1]

    def apply_counted(
        self,
        df: DataFrame,
        keep: Callable[[DataFrame], DataFrame],
        order_by: Sequence[str] | None = None,
        scope: Sequence[str] = (),
    ) -> tuple[DataFrame, DataFrame]:
        """What :meth:`apply` and :meth:`loss_counts` give, with each rule evaluated once.

        ``keep`` writes a table and reads it back. Cell rules that may lose values are written with
        their marks, which are then counted from storage. The result is read back from storage too.
        """
        return self._apply_counted(df, keep, order_by, scope)

    def _apply_counted(
        self, df: DataFrame, keep: Callable[[DataFrame], DataFrame] | None, order_by: Sequence[str] | None, scope: Sequence[str]
    ) -> tuple[DataFrame, DataFrame]:
        positions = {id(rule): i for i, rule in enumerate(self.rules)}
        counted: list[DataFrame] = []
        kept = cells_changed = False
        for run in self.steps():
            if run[0].action == "split_column":
                (rule,) = run
                check(rule, data_columns(df))
                names = rule.parameters["new_column_names"]
                dropped = shape.extra_parts(df, rule.column, rule.parameters["delimiter"], len(names))
                counted.append(
                    _loss_rows(df.agg(count_if(dropped).alias("_lost_0")), {"_lost_0": rule}, positions)
                )
            flags: dict[str, Rule] = {}
            if cells_changed and run[0].action == "drop_empty_rows":
                df = barrier(df, "rows_before_drop")
            cells_changed = cells_changed or run[0].action not in ROW_ACTIONS
            kept = False
            if run[0].action in CELL_ACTIONS:
                df = apply_cell_rules(df, run, flags)
                if flags:
                    if keep:
                        df, kept = keep(df), True
                    sums = df.agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in flags])
                    counted.append(_loss_rows(sums, flags, positions))
                    df = df.drop(*flags)
            else:
                df = _apply_run(df, run, order_by, scope)
        if keep and not kept:
            df = keep(df)
        if not counted:
            return df, df.sparkSession.createDataFrame([], LOSS_SCHEMA)
        out = counted[0]
        for more in counted[1:]:
            out = out.unionByName(more)
        return df, out


LOSS_SCHEMA = "position int, action string, column string, lost bigint"


def _loss_rows(sums: DataFrame, flags: dict[str, Rule], positions: dict[int, int]) -> DataFrame:
    rows_ = [
        F.struct(
            F.lit(positions[id(rule)]).alias("position"),
            F.lit(rule.action).alias("action"),
            F.lit(rule.column).cast("string").alias("column"),
            F.col(flag).cast("long").alias("lost"),
        )
        for flag, rule in flags.items()
    ]
    return sums.select(F.inline(F.array(*rows_)))


def _apply_run(
    df: DataFrame, run: list[Rule], order_by: Sequence[str] | None, scope: Sequence[str]
) -> DataFrame:
    rule = run[0]
    if rule.action in CELL_ACTIONS:
        return apply_cell_rules(df, run)
    check(rule, data_columns(df))
    if rule.action in ROW_ACTIONS:
        if rule.action == "drop_empty_rows":
            return rows.drop_empty_rows(df)
        if rule.action == "dedupe_exact":
            return rows.dedupe_exact(df, scope=scope)
        keys = rule.parameters.get("subset_columns") or [rule.column]
        return rows.dedupe_by_key(df, keys, rule.parameters.get("keep", "first"), order_by, scope)
    if rule.action == "drop_empty_columns":
        return shape.drop_empty_columns(df)
    if rule.action == "split_column":
        return shape.split_column(df, rule.column, **rule.parameters)
    if rule.action == "rename_column":
        return shape.rename_column(df, rule.column, **rule.parameters)
    return shape.merge_columns(df, **rule.parameters)


def _check_run(df: DataFrame, run: list[Rule]) -> None:
    """Count, in one aggregate, what each strict rule of a run would lose at its place."""
    for i, rule in enumerate(run):
        if rule.action != "to_numeric_strict":
            continue
        at = apply_cell_rules(df, [r for r in run[:i] if r.column == rule.column])
        if not isinstance(type_of(at, rule.column), T.StringType):
            continue
        cell = column(rule.column)
        bad = at.filter(numbers.is_lossy(cell)).select(cell.alias("value")).first()
        if bad is not None:
            raise RuleError(
                f"strict conversion of column '{rule.column}' would lose the value {bad.value!r}"
            )
