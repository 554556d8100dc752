import random

import pytest
from pyspark.sql import functions as F

from tablewright.columns import ROW_ID
from tablewright.functions import dates, numbers, text
from tablewright.operators import recheck, rows, shape, validate
from tablewright.plans import rules as R
from tablewright.plans.plan import Plan

MAPPINGS = [
    {"find": "yes", "replace": "Y"}, {"find": ".*", "replace": "dot", "match": "contains"},
    {"find": r"(?P<a>\d+)-(\d+)", "replace": r"\2$\g<a>", "match": "regex"}, {"find": "gone", "replace": None, "match": "contains"},
]
CELL_RULES = {
    "trim_text": R.trim_text("a"), "blank_to_null": R.blank_to_null("a"), "junk_to_null": R.junk_to_null("a", ["?", " "], True),
    "upper": R.normalize_case("a"), "lower": R.normalize_case("a", "lower"), "title": R.normalize_case("a", "title"),
    "numbers": R.normalize_numbers("a"), "us": R.normalize_numbers("a", locale="us", convert_percentages=True),
    "eu": R.normalize_numbers("a", locale="eu", remove_currency=False, handle_parentheses_negatives=False),
    "dates": R.normalize_dates("a"), "month first": R.normalize_dates("a", dayfirst=False), "replace": R.replace_values("a", MAPPINGS),
    "invisibles": R.strip_invisibles("a"),
}
CELLS = [
    None, "", " ", "  ", " x ", "\tyes\n", "a.*b.*", "10-20 and 3-4", "gone away", "N/A", " none", "-", "--", "00", "0", "Sin Dato", "?",
    "o'neil mcdonald", "maría-josé", "ÉCOLE élan", "ß straße", "ǆ", "ΟΔΟΣ Σ", "a\r\n\tb​c﻿", "Ⅷ x", "ŉa",
    "1", "-1.5", "+.5e3", "1e400", "inf", "-Infinity", "nan", "1,234.56", "1.234,56", "1,234", "12,34", "1.234.567", "(1,5)", "$ 1 000", "US$ 5", "U$S7",
    "15%", "(15 %)", "%", "007", "1234567890123", "١٢٣", "1_000", "_1", "1__0", "٣,٥", "--5", "(((3)))", "€", "1,234\n", "2.5\n", "\x1f7",
    "2024-02-03", "2024-2-3", "2024-02-30", "2024/03/04", "2024/13/04", "03/04/2024", "13/04/2024", "04/13/2024", "31.12.99", "1-2-24", "1/2/80", "20240229",
    "20230229", "3/2024", "03-2024", "5 Mar 2024", "5-march-2024", "Mar 5, 2024", "MAY 05 2024", "Sept 5 2024", " 2024-01-02", "2024-01-02 10:00", "2024",
    "01/02/2024 10:00:00.5 pm", "2024-01-02T03:04", "3/4/2024\n", "0000-01-01", "1/1/0000", "99/99/9999", "2024.5.6", "5/mar/2024", "mayo 5 2024",
]


def fuzz(rng, n=1500):
    pools = ["0123456789.,()$%-+ ", "0123456789/-. :T", "aÉßΣ'- \n\t ", "0١9_,.eE+-", "JanuryMchDe 0123/-,"]
    return ["".join(rng.choice(rng.choice(pools) if rng.random() < 0.1 else pool) for _ in range(rng.randint(1, 12))) for pool in rng.choices(pools, k=n)]


def table(spark):
    cells = CELLS + fuzz(random.Random(9)) + [f" {c} " for c in CELLS if c]
    return spark.createDataFrame([(i, c, float(i % 7)) for i, c in enumerate(cells)], f"{ROW_ID} long, a string, x double").repartition(4).cache()


def test_both_forms_agree_on_every_cell_rule(spark):
    df = table(spark)
    for name, rule in CELL_RULES.items():
        plan = Plan((rule,)).approve()
        one, two = plan.apply(df), recheck.evaluate(plan, df)
        assert one.schema.simpleString() == two.schema.simpleString()
        apart = one.join(two.select(ROW_ID, F.col("a").alias("b")), ROW_ID).filter("not a <=> b").join(df.select(ROW_ID, F.col("a").alias("cell")), ROW_ID)
        assert apart.select("cell", "a", "b").limit(5).collect() == [], name
    strict = df.filter(numbers.is_lossy(F.col("a")) == F.lit(False))
    plan = Plan((R.to_numeric_strict("a"),)).approve()
    assert plan.apply(strict).exceptAll(recheck.evaluate(plan, strict)).isEmpty()


SHAPES = {
    "drop_empty_rows": R.drop_empty_rows(), "drop_empty_columns": R.drop_empty_columns(), "dedupe_exact": R.dedupe_exact(),
    "first": R.dedupe_by_key(["k"]), "last": R.dedupe_by_key(["k", "b"], keep="last"), "split": R.split_column("a", ".", ["a", "p"]),
    "merge": R.merge_columns(["a", "x", "b"], "m", "-", True), "merge in place": R.merge_columns(["a", "b"], "b"), "rename": R.rename_column("a", "z"),
}


def shapes_table(spark):
    rng = random.Random(3)
    pick = lambda *values: rng.choice(values)
    rows_ = [(i, pick("k1", "k2", None), pick("a.b", " c . d.e", None, ""), pick("b", None), pick(1.5, float("nan"), None), None) for i in range(300)]
    rows_ += [(1000 + i, None, None, None, float("nan"), None) for i in range(3)]
    return spark.createDataFrame(rows_, f"{ROW_ID} long, k string, a string, b string, x double, empty string").repartition(3)


def test_both_forms_agree_on_rules_for_rows_and_columns(spark):
    df = shapes_table(spark)
    for name, rule in SHAPES.items():
        plan = Plan((rule,)).approve()
        one, two = plan.apply(df), recheck.evaluate(plan, df)
        assert one.columns == two.columns, name
        assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty(), name


WRONG = [
    ("trim_text", R.trim_text("a"), text, "trim_text", lambda c: F.trim(c)),
    ("blank_to_null", R.blank_to_null("a"), text, "blank_to_null", lambda c: F.nullif(c, F.lit(""))),
    ("junk_to_null", R.junk_to_null("a"), text, "junk_to_null", lambda c, *a, **k: F.nullif(c, F.lit("N/A"))),
    ("normalize_case", R.normalize_case("a", "title"), text, "normalize_case", lambda c, format: F.initcap(c)),
    ("replace_values", R.replace_values("a", MAPPINGS), text, "replace_values", lambda c, mappings: F.replace(c, F.lit("yes"), F.lit("Y"))),
    ("strip_invisibles", R.strip_invisibles("a"), text, "strip_invisibles", lambda c: F.regexp_replace(c, r"\s+", " ")),
    ("normalize_numbers", R.normalize_numbers("a"), numbers, "number_value", lambda c, t, *rest: F.translate(t, ",", "").try_cast("double")),
    ("normalize_dates", R.normalize_dates("a"), dates, "date_value", lambda c, t, o, *rest: t.try_cast("date")),
    ("dedupe_exact", R.dedupe_exact(), rows, "dedupe_exact", lambda df, scope=(): df),
    ("dedupe_by_key", R.dedupe_by_key(["k"]), rows, "dedupe_by_key", lambda df, keys, *rest: df.filter(f"{ROW_ID} < 3")),
    ("drop_empty_rows", R.drop_empty_rows(), rows, "drop_empty_rows", lambda df: df.na.drop("any")),
    ("drop_empty_columns", R.drop_empty_columns(), shape, "drop_empty_columns", lambda df: df.drop("b")),
    ("split_column", R.split_column("a", ".", ["a", "p"]), shape, "split_column", lambda df, *a, **k: df.withColumn("p", F.col("a"))),
    ("merge_columns", R.merge_columns(["a", "b"], "b"), shape, "merge_columns", lambda df, *a, **k: df.withColumn("b", F.concat_ws(" ", "a", "b"))),
    ("rename_column", R.rename_column("a", "z"), shape, "rename_column", lambda df, *a, **k: df.withColumnRenamed("b", "z")),
]


@pytest.mark.parametrize("name, rule, module, function, wrong", WRONG, ids=[w[0] for w in WRONG])
def test_a_faulty_rule_does_not_validate_itself(spark, monkeypatch, name, rule, module, function, wrong):
    df = shapes_table(spark).unionByName(
        spark.createDataFrame([(5000 + i, "k1", c, "b", 1.0, None) for i, c in enumerate(CELLS)], f"{ROW_ID} long, k string, a string, b string, x double, empty string")
    )
    plan = Plan((rule,)).approve()
    assert validate.validate(df, plan.apply(df), plan).valid
    monkeypatch.setattr(module, function, wrong)
    assert not validate.validate(df, plan.apply(df), plan).valid


def test_a_faulty_strict_rule_does_not_validate_itself(spark, monkeypatch):
    df = spark.createDataFrame([(1, " 12 "), (2, "1e3"), (3, None), (4, " ")], f"{ROW_ID} long, a string")
    plan = Plan((R.to_numeric_strict("a"),)).approve()
    assert validate.validate(df, plan.apply(df), plan).valid
    monkeypatch.setattr(numbers, "parse_strict", lambda c: F.regexp_extract(c, "[0-9]+", 0).try_cast("double"))
    assert not validate.validate(df, plan.apply(df), plan).valid
