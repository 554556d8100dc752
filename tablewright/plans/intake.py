"""Intake of proposed rules from raw JSON responses in a text column."""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.columns import column, quoted, text_columns
from tablewright.functions import text as cells
from tablewright.plans.plan import Plan
from tablewright.plans.rules import ACTIONS, Rule


# A response names rules of the engine, not functions of the caller.
PROPOSABLE = tuple(action for action in ACTIONS if action != "custom")


def intake_proposals(
    df: DataFrame,
    response: str,
    keys: Sequence[str] = (),
    most: int | None = None,
    reason_chars: int | None = None,
) -> DataFrame:
    """(keys..., ordinal, action, column, reason, confidence, parameters, accepted, note).

    One row per proposal and one for a response without usable proposals. Rejected rows say why;
    accepted rows still need approval before anything is applied. A caller may refuse proposals of
    one response beyond ``most`` and shorten reasons to ``reason_chars``; neither is done by itself.
    """
    parsed = df.select(
        *[column(k) for k in keys], F.try_parse_json(column(response)).alias("_doc")
    ).select(
        *[column(k) for k in keys],
        F.schema_of_variant(F.try_variant_get("_doc", "$.proposals", "variant")).alias("_kind"),
        F.try_variant_get("_doc", "$.proposals", "array<variant>").alias("_list"),
    )
    one = parsed.select(
        *[column(k) for k in keys],
        "_kind",
        F.posexplode_outer("_list").alias("ordinal", "_item"),
    )

    def field(name: str, kind: str = "string"):
        return F.try_variant_get("_item", f"$.{name}", kind)

    item_kind = F.schema_of_variant("_item")
    number = F.schema_of_variant(field("confidence", "variant"))
    read = one.select(
        *[column(k) for k in keys],
        "_kind",
        "ordinal",
        item_kind.startswith("OBJECT").alias("_object"),
        field("action").alias("action"),
        field("column").alias("column"),
        F.schema_of_variant(field("reason", "variant")).alias("_reason_kind"),
        F.coalesce(field("reason"), F.lit("")).alias("_reason"),
        # A JSON true counts as 1.0; a number written as text does not count.
        F.when(
            number.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"),
            F.when(number == "BOOLEAN", field("confidence", "boolean").cast("double")).otherwise(
                field("confidence", "double")
            ),
        ).alias("_confidence"),
        F.when(
            F.schema_of_variant(field("parameters", "variant")).startswith("OBJECT"),
            F.to_json(field("parameters", "variant")),
        )
        .otherwise("{}")
        .alias("parameters"),
    )
    rejected = (
        F.when(F.col("_kind").isNotNull() & ~F.col("_kind").startswith("ARRAY"), "proposals is not a list")
        .when(F.col("ordinal").isNull(), "no valid proposal")
        .when(F.lit(most is not None) & (F.col("ordinal") >= (most or 0)), f"over the limit of {most} proposals")
        .when(~F.coalesce("_object", F.lit(False)), "not an object")
        .when(F.col("action").isNull() | ~F.col("action").isin(*PROPOSABLE), "unknown action")
        .when(F.col("_confidence").isNull(), "confidence is not a number")
        .when(~F.col("_confidence").between(0, 1), "confidence is out of range")
        .when(F.col("_reason_kind").isNotNull() & (F.col("_reason_kind") != "STRING"), "reason is not text")
    )
    too_long = F.length("_reason") > reason_chars if reason_chars is not None else F.lit(False)
    reason = F.substring("_reason", 1, reason_chars) if reason_chars is not None else F.col("_reason")
    return read.select(
        *[column(k) for k in keys],
        "ordinal",
        "action",
        "column",
        reason.alias("reason"),
        F.col("_confidence").alias("confidence"),
        "parameters",
        rejected.isNull().alias("accepted"),
        F.coalesce(rejected, F.when(too_long, "reason was shortened")).alias("note"),
    )


def _plan(rows: list) -> Plan:
    return Plan(
        tuple(Rule(r.action, r.column, json.loads(r.parameters), r.reason, False, "proposal") for r in rows)
    )


def rules_from_proposals(proposals: DataFrame) -> Plan:
    """All accepted proposals of one response, in their order, as unapproved rules."""
    return _plan(proposals.filter("accepted").orderBy("ordinal").collect())


def plan_sizes(proposals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., n_rules): the number of accepted proposals per key, counted without gathering any."""
    return proposals.filter("accepted").groupBy(*[column(k) for k in keys]).agg(F.count("*").alias("n_rules"))


def plans_from_proposals(proposals: DataFrame, keys: Sequence[str], of: tuple | None = None) -> dict[tuple, Plan]:
    """One plan of unapproved rules per key; every accepted proposal is in the plan of its key.

    Plans are objects of the driver, so their rules are gathered there. ``of`` names the one key
    whose plan is wanted; without it, all proposals have to fit the driver.
    """
    for k, value in zip(keys, of or ()):
        proposals = proposals.filter(column(k).eqNullSafe(value))
    rows = proposals.filter("accepted").orderBy(*[column(k) for k in keys], "ordinal").collect()
    return {key: _plan(list(group)) for key, group in groupby(rows, lambda r: tuple(r[k] for k in keys))}


# Cell rules that a table of proposals can name, by action and case format (empty: no parameter).
BY_TABLE = {
    ("trim_text", ""): cells.trim_text,
    ("strip_invisibles", ""): cells.strip_invisibles,
    ("blank_to_null", ""): cells.blank_to_null,
    ("junk_to_null", ""): cells.junk_to_null,
    **{
        ("normalize_case", form): (lambda cell, form=form: cells.normalize_case(cell, form))
        for form in ("lower", "upper", "title")
    },
}


def _case_format() -> Column:
    form = F.coalesce(F.get_json_object("parameters", "$.format"), F.lit("title"))
    return F.when(F.col("action") == "normalize_case", form).otherwise("")


def applicable(proposals: DataFrame, columns: Sequence[str]) -> Column:
    """Whether an accepted proposal is a rule that :func:`apply_by_key` can run on one of ``columns``.

    A proposal with parameters other than a known case format is not, as its parameter would be lost.
    """
    names = F.map_keys(F.from_json("parameters", "map<string,string>"))
    known = F.lit(False)
    for action, form in BY_TABLE:
        known = known | ((F.col("action") == action) & (_case_format() == form))
    allowed = F.when(F.col("action") == "normalize_case", F.array(F.lit("format"))).otherwise(F.array().cast("array<string>"))
    bare = F.size(F.array_except(F.coalesce(names, F.array().cast("array<string>")), allowed)) == 0
    return F.coalesce(F.col("accepted") & F.col("column").isin(*columns) & known & bare, F.lit(False))


def key_rules(proposals: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys..., rules): one row per key with its different rules in order of their first ordinal.

    Proposals repeat in many responses of a key, so equal ones become one before they are gathered;
    what is left is bounded by columns times actions. Ties of the ordinal go by action, then format.
    """
    named = [column(k) for k in keys]
    chosen = proposals.filter(applicable(proposals, columns)).select(
        *named, "ordinal", "action", _case_format().alias("_format"), F.col("column").alias("_column")
    )
    once = chosen.groupBy(*named, "_column", "action", "_format").agg(F.min("ordinal").alias("_first"))
    rule = F.struct("_first", "action", "_format", "_column")
    return once.groupBy(*named).agg(F.array_sort(F.collect_list(rule)).alias("rules"))


def apply_by_key(df: DataFrame, proposals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row under the approved proposals of its own key, which stay a table and never reach the driver.

    ``proposals`` holds the rows of :func:`intake_proposals` that were approved, with ``keys``, columns of
    ``df`` too. Rules of a column run in order, each on the result of the one before; key columns are
    never changed. Rows of keys without rules, and null keys that no proposal names, stay as they are.
    """
    names = [n for n in text_columns(df) if n not in keys]
    rules = key_rules(proposals, keys, names).select(*[column(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("rules").alias("_rules"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"_data.{quoted(k)}").eqNullSafe(F.col(f"_ruled._key{i}"))
    joined = df.alias("_data").join(rules.alias("_ruled"), same, "left")

    def step(cell: Column, rule: Column) -> Column:
        chain = F.when(F.lit(False), cell)
        for (action, form), function in BY_TABLE.items():
            chain = chain.when((rule["action"] == action) & (rule["_format"] == form), function(cell))
        return chain.otherwise(cell)

    def ruled(name: str) -> Column:
        cell = F.col(f"_data.{quoted(name)}")
        own = F.filter("_ruled._rules", lambda rule: rule["_column"] == name)
        return F.when(F.size(own) > 0, F.aggregate(own, cell, step)).otherwise(cell)

    return joined.select(
        *[(ruled(n) if n in names else F.col(f"_data.{quoted(n)}")).alias(n) for n in df.columns]
    )
