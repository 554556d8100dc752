"""Rules as data: proposals per key applied by a join."""

from pyspark.sql import functions as F

from tablewright.plans.intake import apply_by_key, intake_proposals, key_rules


def proposal(action, name, parameters="{}"):
    return f'{{"action":"{action}","column":"{name}","confidence":1,"parameters":{parameters}}}'


def proposals(spark, rows):
    table = [(team, '{"proposals":[' + ",".join(items) + "]}") for team, items in rows]
    return intake_proposals(spark.createDataFrame(table, "team string, response string"), "response", ["team"])


def test_each_row_under_the_rules_of_its_key_in_order(spark):
    found = proposals(spark, [
        ("a", [proposal("trim_text", "x"), proposal("normalize_case", "x", '{"format":"upper"}'), proposal("trim_text", "team")]),
        ("a", [proposal("trim_text", "x")]),
        # The first turns blanks to null before anything is trimmed; the other case formats are unknown or carry more.
        ("b", [proposal("blank_to_null", "x"), proposal("normalize_case", "y", '{"format":"odd"}'), proposal("junk_to_null", "y", '{"extras":["q"]}')]),
        (None, [proposal("normalize_case", "x")]),
        ("c", []),
    ])
    rows = [
        (1, "a", " p ", " q ", "kept"), (2, "b", "  ", "q", "kept"), (3, None, "one two", None, "kept"),
        (4, "c", " z ", " z ", "kept"), (5, "d", None, "", "kept"), (6, "a", None, None, "kept"), (1, "a", " p ", " q ", "kept"),
    ]
    df = spark.createDataFrame(rows, "id int, team string, x string, y string, _rules string")
    got = sorted(map(tuple, apply_by_key(df, found, ["team"]).collect()), key=lambda r: r[0])
    assert got == [
        (1, "a", "P", " q ", "kept"), (1, "a", "P", " q ", "kept"), (2, "b", None, "q", "kept"), (3, None, "One Two", None, "kept"),
        (4, "c", " z ", " z ", "kept"), (5, "d", None, "", "kept"), (6, "a", None, None, "kept"),
    ]


def test_repeated_proposals_are_one_rule(spark):
    found = proposals(spark, [("a", [proposal("trim_text", "x"), proposal("blank_to_null", "x")])] * 500)
    rules = key_rules(found, ["team"], ["x"]).select(F.transform("rules", lambda r: r["action"]).alias("actions")).collect()
    assert [r.actions for r in rules] == [["trim_text", "blank_to_null"]]


def test_no_rules_and_no_rows(spark):
    nothing = proposals(spark, [("a", [])])
    df = spark.createDataFrame([("a", " x ")], "team string, x string")
    assert apply_by_key(df, nothing, ["team"]).collect() == df.collect()
    assert apply_by_key(df.limit(0), nothing, ["team"]).collect() == []
