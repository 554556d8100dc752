import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import constants as K
from tablewright.functions import dates, numbers, text
from tablewright.plans import rules as R
from tablewright.plans.plan import Plan

PIVOT = 2076
NUL = None

NUMBERS = [
    # text, auto, us, eu, auto with percentages
    ("1.250,50", 1250.5, 1.2505, 1250.5, 1250.5),
    ("1,250.50", 1250.5, 1250.5, NUL, 1250.5),
    ("1,250", 1250, 1250, 1.25, 1250),
    ("1,250,000", 1250000, 1250000, NUL, 1250000),
    ("0,125", 125, 125, 0.125, 125),
    ("900,00", 900, 90000, 900, 900),
    ("12,5", 12.5, 125, 12.5, 12.5),
    ("5,a", NUL, NUL, NUL, NUL),
    ("1.250", 1.25, 1.25, 1.25, 1.25),
    ("€ 1.200", 1.2, 1.2, 1.2, 1.2),
    ("1.250.000", NUL, NUL, NUL, NUL),
    ("08011", NUL, 8011, 8011, NUL),
    ("+08011", NUL, 8011, 8011, NUL),
    ("00", NUL, 0, 0, NUL),
    ("0", 0, 0, 0, 0),
    ("-5", -5, -5, -5, -5),
    ("150", 150, 150, 150, 150),
    ("1234567890123", NUL, 1234567890123, 1234567890123, NUL),
    ("1234567890123.0", 1234567890123, 1234567890123, 1234567890123, 1234567890123),
    ("(150,00)", -150, -15000, -150, -150),
    ("($5)", -5, -5, -5, -5),
    ("$(5)", NUL, NUL, NUL, NUL),
    ("US$ 900,00", 900, 90000, 900, 900),
    ("1 250,50", 1250.5, 125050, 1250.5, 1250.5),
    ("15%", NUL, NUL, NUL, 0.15),
    ("1e5", 100000, 100000, 100000, 100000),
    ("1_000", 1000, 1000, 1000, 1000),
    ("inf", float("inf"), float("inf"), float("inf"), float("inf")),
    ("usd 5", NUL, NUL, NUL, NUL),
    ("nan", NUL, NUL, NUL, NUL),
    ("-", NUL, NUL, NUL, NUL),
    ("", NUL, NUL, NUL, NUL),
    ("12d", NUL, NUL, NUL, NUL),
    (NUL, NUL, NUL, NUL, NUL),
]


def test_normalize_numbers(spark):
    df = spark.createDataFrame([(i, row[0]) for i, row in enumerate(NUMBERS)], "i int, v string")
    c = F.col("v")
    got = df.select(
        "i",
        numbers.normalize_numbers(c).alias("auto"),
        numbers.normalize_numbers(c, "us").alias("us"),
        numbers.normalize_numbers(c, "eu").alias("eu"),
        numbers.normalize_numbers(c, convert_percentages=True).alias("pct"),
    ).orderBy("i").collect()
    for row in got:
        assert tuple(row)[1:] == NUMBERS[row.i][1:], NUMBERS[row.i][0]


DATES = [
    ("12/05/2026", "2026-05-12", "2026-12-05"),
    (" 12/05/2026 ", "2026-05-12", "2026-12-05"),
    ("12.05.2026", "2026-05-12", "2026-12-05"),
    ("12/05/26", "2026-05-12", "2026-12-05"),
    ("09-05-2026", "2026-05-09", "2026-09-05"),
    ("12/25/2025", "2025-12-25", "2025-12-25"),
    ("25/12/2025", "2025-12-25", "2025-12-25"),
    ("2026-05-12", "2026-05-12", "2026-05-12"),
    ("20260512", "2026-05-12", "2026-05-12"),
    ("12 May 2026", "2026-05-12", "2026-05-12"),
    ("12-May-2026", "2026-05-12", "2026-05-12"),
    ("May 12 2026", "2026-05-12", "2026-05-12"),
    ("May 12, 2026", "2026-05-12", "2026-05-12"),
    ("2026-5-1", "2026-05-01", "2026-05-01"),
    ("2026/03/05", "2026-03-05", "2026-03-05"),
    ("2025/13/01", "2025-01-13", NUL),
    ("15/03/2025 14:00", "2025-03-15", "2025-03-15"),
    ("15/03/2025T14:00:00", "2025-03-15", "2025-03-15"),
    ("5/3/2025 2:30 PM", "2025-03-05", "2025-05-03"),
    ("5/2026", "2026-05-01", "2026-05-01"),
    ("31/12/99", "1999-12-31", "1999-12-31"),
    *[
        (bad, NUL, NUL)
        for bad in (
            "2026-05-12 10:30", "2025-05-10 ", "2026", "2026-13-01", "2026-02-30", "13/13/2026", "31/02/2025",
            "0012/05/2026", "12/5", "1", "45000", "no es fecha", "12 mayo 2026", "", "1.250,50", "today", "10:30",
            "Sept 3 2025", "x" * 500, NUL,
        )
    ],
]


def test_normalize_dates_in_column_and_in_plan(spark):
    df = spark.createDataFrame([(i, row[0]) for i, row in enumerate(DATES)], "i int, v string")
    plain = df.select(
        "i",
        dates.normalize_dates(F.col("v"), True, PIVOT).alias("d"),
        dates.normalize_dates(F.col("v"), False, PIVOT).alias("m"),
    )
    for row in plain.collect():
        assert (row.d, row.m) == DATES[row.i][1:], DATES[row.i][0]
    planned = Plan((R.normalize_dates("v", pivot_year=PIVOT),)).approve().apply(df)
    for row in planned.collect():
        assert row.v == DATES[row.i][1], DATES[row.i][0]


def test_lenient_dates_accept_times_and_years(spark):
    df = spark.createDataFrame([("2026-05-12 10:30",), ("2026-05-12T10:30:00",), ("2025-05-10 ",), ("2026",)], "v string")
    got = df.select(dates.normalize_dates(F.col("v"), True, PIVOT, True)).collect()
    assert [r[0] for r in got] == ["2026-05-12", "2026-05-12", "2025-05-10", "2026-01-01"]


def test_strip_agrees_with_python_whitespace(spark):
    assert len(K.WHITESPACE) == 29
    values = [ch + "a b" + ch for ch in K.WHITESPACE] + ["​ x", "", "  "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    for row in df.select("i", text.strip(F.col("v")).alias("s")).collect():
        assert row.s == values[row.i].strip()


def test_title_agrees_with_python(spark):
    values = ["O'Neil mcDONALD", "abc2def", "maría-josé", "3rd JOHN's", "中a", "ßä straße", "", "  x "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    for row in df.select("i", text.title_case(F.col("v")).alias("s")).collect():
        assert row.s == values[row.i].title()


def test_junk(spark):
    values = ["N/A", "null", "None", "Activo", "-", "n.d.", "NULL", "N/A ", "0", "00", " ", "sin dato", NUL]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    plain = [r[0] for r in df.orderBy("i").select(text.junk_to_null(F.col("v"))).collect()]
    assert plain == [NUL, NUL, NUL, "Activo", NUL, "n.d.", NUL, NUL, "0", "00", " ", NUL, NUL]
    extra = [r[0] for r in df.orderBy("i").select(text.junk_to_null(F.col("v"), ["n.d."], True)).collect()]
    assert extra == [NUL, NUL, NUL, "Activo", NUL, NUL, NUL, NUL, NUL, NUL, " ", NUL, NUL]


def test_replace_first_match_wins(spark):
    mappings = [
        {"find": "N/A", "replace": None},
        {"find": "null", "replace": None},
        {"find": "-", "replace": None, "match": "contains"},
        {"find": "5", "replace": "CINCO", "match": "contains"},
        {"find": r"x(\d)y", "replace": r"n=\1", "match": "regex"},
    ]
    values = ["N/A", "null", "---", "15", "x7y", "OK", NUL]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(text.replace_values(F.col("v"), mappings)).collect()]
    assert got == [NUL, NUL, NUL, "1CINCO", "n=7", "OK", NUL]


@pytest.mark.parametrize(
    "pattern,template,value",
    [(r"(?P<a>\w)-(?P<b>\w)", r"\g<b>$\g<a>", "x-y"), (r"b+\Z", "$1", "abb"), (r"a", r"\\", "a.a"), (r"(a)", r"\1\1", "ba")],
)
def test_python_regex_dialect(spark, pattern, template, value):
    import re

    df = spark.createDataFrame([(value,)], "v string")
    mapping = [{"find": pattern, "replace": template, "match": "regex"}]
    assert df.select(text.replace_values(F.col("v"), mapping)).first()[0] == re.sub(pattern, template, value)


def test_invisibles_and_formulas(spark):
    df = spark.createDataFrame([("a\r\n\tb ​c",)], "v string")
    assert df.select(text.strip_invisibles(F.col("v"))).first()[0] == "a bc"
    values = ["=1", "+1", "-1", "@x", "\tx", " =1", "x", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(text.neutralize_formula(F.col("v"))).collect()]
    assert got == ["'=1", "'+1", "'-1", "'@x", "'\tx", " =1", "x", ""]


def test_double_text_agrees_with_python(spark):
    values = [1e10, 0.0001, 1.5e-5, 1e16, 1.0, 0.1, 123456789.125, -0.0, 1e-3, 3.3e20, -2.5e7, float("inf"), 1e22]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for row in df.select("i", text.as_text(F.col("v"), T.DoubleType()).alias("s")).collect():
        assert row.s == str(values[row.i])


def test_strict_numbers(spark):
    good = spark.createDataFrame([("10",), (" 20.5 ",), ("",), ("  ",), (None,)], "v string")
    plan = Plan((R.to_numeric_strict("v"),)).approve()
    plan.check_strict(good)
    assert [r.v for r in plan.apply(good).collect()] == [10.0, 20.5, None, None, None]
    bad = spark.createDataFrame([("10",), ("ABC",)], "v string")
    with pytest.raises(R.RuleError, match="ABC"):
        plan.check_strict(bad)
    with pytest.raises(Exception, match="ABC"):
        plan.apply(bad).collect()
    for value in ("12d", "1f", "0x1p3", "1e400", "1_000", "1,5"):
        df = spark.createDataFrame([(value,)], "v string")
        assert df.select(numbers.is_lossy(F.col("v"))).first()[0], value
