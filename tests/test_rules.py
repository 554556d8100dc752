import random

import pytest
from pyspark.sql import functions as F

from tablewright.columns import ROW_ID
from tablewright.operators import rows, shape
from tablewright.plans import rules as R
from tablewright.plans.plan import Plan


@pytest.mark.parametrize(
    "make",
    [
        lambda: R.split_column("a", "", ["x"]),
        lambda: R.split_column("a", "-", ["x", "x"]),
        lambda: R.split_column("a", "-", []),
        lambda: R.merge_columns(["a"], "x"),
        lambda: R.merge_columns(["a", "b"], " "),
        lambda: R.dedupe_by_key(["a"], "middle"),
        lambda: R.dedupe_by_key([]),
        lambda: R.replace_values("a", []),
        lambda: R.replace_values("a", [{"find": ""}]),
        lambda: R.replace_values("a", [{"find": "x", "match": "like"}]),
        lambda: R.replace_values("a", [{"find": "(", "match": "regex"}]),
        lambda: R.replace_values("a", [{"find": "x", "replace": 1}]),
        lambda: R.junk_to_null("a", ["x", ""]),
        lambda: R.trim_text(""),
        lambda: R.check(R.Rule("drop_table")),
    ],
)
def test_invalid_rules_are_refused(make):
    with pytest.raises(ValueError):
        make()


def test_constructors_parse_lists_and_stay_unapproved():
    rule = R.dedupe_by_key(" a , b ", "last")
    assert rule.parameters == {"subset_columns": ["a", "b"], "keep": "last"} and not rule.approved
    assert R.split_column("c", ";", "x, y").parameters["new_column_names"] == ["x", "y"]


def test_plan_json_and_approval_round_trip():
    plan = Plan((R.trim_text("a"), R.replace_values("b", [{"find": "ñ", "replace": None}]), R.flag_for_review("c")))
    again = Plan.from_json(plan.approve([1]).to_json())
    assert [r.approved for r in again.rules] == [False, True, False]
    assert again.rules[1].parameters == plan.rules[1].parameters
    withdrawn = again.approve(lambda r: r.action == "replace_values", False)
    assert withdrawn.approved == () and withdrawn.rules[1].source == "user"
    with pytest.raises(R.RuleError):
        Plan.from_json('[{"action": "split_column", "column": "a", "parameters": {}}]')


def test_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "x", None), (None, None, None), (2, "y", None)], "a int, b string, c double")
    assert rows.drop_empty_rows(df).count() == 2
    assert shape.drop_empty_columns(df).columns == ["a", "b"]
    nan = spark.createDataFrame([(float("nan"), None), (1.0, None)], "a double, `b.c` string")
    assert rows.drop_empty_rows(nan).count() == 1
    assert shape.empty_columns(nan) == ["b.c"]


def test_exact_dedupe_keeps_the_first(spark):
    data = [(5, "a", None), (3, "a", None), (4, "b", 1.0), (9, "b", 1.0)]
    df = spark.createDataFrame(data, f"{ROW_ID} long, v string, n double")
    assert sorted(r[ROW_ID] for r in rows.dedupe_exact(df).collect()) == [3, 4]
    assert rows.dedupe_exact(df.drop(ROW_ID)).count() == 2


def test_key_dedupe(spark):
    data = [(1, "a", 10), (2, "b", 20), (3, "a", 30), (4, None, 40), (5, None, 50)]
    df = spark.createDataFrame(data, "id int, mail string, amount int")
    first = rows.dedupe_by_key(df, ["mail"], "first", ["id"])
    last = rows.dedupe_by_key(df, ["mail"], "last", ["id"])
    assert sorted(r.id for r in first.collect()) == [1, 2, 4]
    assert sorted(r.id for r in last.collect()) == [2, 3, 5]
    with pytest.raises(ValueError):
        rows.dedupe_by_key(df, ["mail"])
    with pytest.raises(R.RuleError):
        Plan((R.dedupe_by_key(["nope"]),)).approve().apply(df, ["id"])


def test_split_and_merge(spark):
    data = [("Ana Silva", 1), ("Juan Pérez Gil", 2), ("Sol", 3), (None, 4)]
    df = spark.createDataFrame(data, "full string, age int")
    plan = Plan((R.split_column("full", " ", ["first", "second"]),)).approve()
    out = plan.apply(df)
    assert out.columns == ["first", "second", "age"]
    assert [tuple(r)[:2] for r in out.orderBy("age").collect()] == [("Ana", "Silva"), ("Juan", "Pérez"), ("Sol", None), (None, None)]
    assert plan.loss_counts(df).first().lost == 1
    literal = spark.createDataFrame([("a.b|c",)], "v string")
    assert tuple(shape.split_column(literal, "v", ".", ["v", "w"]).first()) == ("a", "b|c")
    three = spark.createDataFrame([("Ana", "Silva", "Salta"), ("Beto", None, "Lima")], "n string, s string, c string")
    merged = shape.merge_columns(three, ["n", "s", "c"], "all", "-")
    assert merged.columns == ["all", "n", "s", "c"]
    assert [r[0] for r in merged.orderBy("n").collect()] == ["Ana-Silva-Salta", "Beto--Lima"]
    typed = spark.createDataFrame([(1e10, True, 7)], "a double, b boolean, c int")
    assert shape.merge_columns(typed, ["a", "b", "c"], "t", "|", True).first().t == "10000000000.0|True|7"
    replaced = shape.merge_columns(three, ["n", "s"], "s", "_", True)
    assert replaced.columns == ["s", "c"]


def test_order_of_rules_matters(spark):
    df = spark.createDataFrame([(1, " Juan "), (2, "Juan")], f"{ROW_ID} long, v string")
    trim, dedupe = R.trim_text("v"), R.dedupe_exact()
    assert Plan((trim, dedupe)).approve().apply(df).count() == 1
    assert Plan((dedupe, trim)).approve().apply(df).count() == 2


def test_only_approved_rules_run_and_types_are_respected(spark):
    df = spark.createDataFrame([(" a ", 5)], "v string, n bigint")
    assert Plan((R.trim_text("v"),)).apply(df).first().v == " a "
    plan = Plan((R.trim_text("n"), R.junk_to_null("n"), R.normalize_case("n"), R.flag_for_review("v"))).approve()
    assert plan.apply(df).first().n == 5
    notes = " ".join(plan.warnings(df))
    assert "no effect" in notes and "review" in notes


@pytest.mark.parametrize("seed", range(4))
def test_rows_stay_whole(spark, seed):
    """Cells say where they came from; whatever the rule order and partitioning, rows never mix."""
    names = ["c0", "c1", "c2"]
    data = [(i, *[f" r{i}|{c} " if i % 3 else f"r{i}|{c}" for c in names]) for i in range(40)]
    data += [(100, None, None, None), (101, *data[5][1:])]
    rules = [R.trim_text(c) for c in names] + [R.drop_empty_rows(), R.normalize_case("c1", "lower"), R.blank_to_null("c2")]
    rng = random.Random(seed)
    rng.shuffle(rules)
    plan = Plan((*rules, R.dedupe_exact())).approve()
    results = []
    for parts in (1, 3, 8):
        df = spark.createDataFrame(data, f"{ROW_ID} long, c0 string, c1 string, c2 string").repartition(parts)
        results.append(sorted(tuple(r) for r in plan.apply(df).collect()))
    assert results[0] == results[1] == results[2] and len(results[0]) == 40
    for row in results[0]:
        assert {cell.split("|")[0] for cell in row[1:]} == {f"r{row[0]}"}


def test_cell_rules_use_no_python_and_few_projections(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("a"), F.lit(" x ").alias("b"))
    plan = Plan((R.trim_text("a"), R.trim_text("b"), R.normalize_numbers("a"), R.normalize_dates("b"), R.strip_invisibles("b"))).approve()
    physical = plan.apply(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in physical and "Arrow" not in physical and "Exchange" not in physical
    assert physical.count("Project") <= 6


def test_key_dedupe_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    physical = rows.dedupe_by_key(df, ["k"], "first", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in physical and "Partial" in physical


def test_rename_and_custom_rules(spark):
    from tablewright.runner import clean_table

    R.register_custom("shout", lambda cell: F.concat(cell, F.lit("!")))
    with pytest.raises(R.RuleError):
        R.custom("a", "unknown")
    with pytest.raises(R.RuleError):
        R.rename_column("a", "_row_id")
    plan = Plan((R.custom("Columna_1", "shout"), R.rename_column("Columna_1", "name"), R.trim_text("name"))).approve()
    assert Plan.from_json(plan.to_json()) == plan
    df = spark.createDataFrame([(" a", 1), (None, 2)], "Columna_1 string, n int")
    outcome = clean_table(df, plan)
    assert outcome.validation.valid and sorted(map(tuple, outcome.cleaned.select("n", "name").collect())) == [(1, "a!"), (2, None)]
    assert outcome.cleaned.columns[1:] == ["name", "n"]
    with pytest.raises(R.RuleError):
        Plan((R.rename_column("Columna_1", "n"),)).approve().apply(df)
