import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.columns import ROW_ID
from tablewright.operators import detect, profile
from tablewright.operators.quantiles import exact_quantiles
from tablewright.plans import propose
from tablewright.plans import rules as R
from tablewright.plans.intake import intake_proposals, plan_sizes, plans_from_proposals, rules_from_proposals


def found(issues):
    return {(r.category, r["column"]): r for r in issues.collect()}


def test_profile(spark):
    data = [(2, "b", 1.0), (0, "a", float("nan")), (1, "b", None), (3, None, 2.5)]
    df = spark.createDataFrame(data, f"{ROW_ID} long, s string, d double")
    got = {r["column"]: r for r in profile.profile(df).collect()}
    assert (got["s"].non_null, got["s"].nulls, got["s"].distinct, got["s"].samples) == (3, 1, 2, ["a", "b"])
    assert (got["d"].non_null, got["d"].nulls, got["d"].distinct, got["d"].samples) == (2, 2, 2, ["1.0", "2.5"])
    approx = {r["column"]: r for r in profile.profile(df, approx=True).collect()}
    assert (approx["d"].non_null, approx["d"].distinct) == (2, 2)
    empty = profile.profile(df.limit(0)).collect()
    assert [(r.non_null, r.nulls, r.distinct) for r in empty] == [(0, 0, 0)] * 2
    assert tuple(profile.table_stats(df).first()) == (4, 2)


@pytest.mark.parametrize("limit", [5, 50, 10_000])
def test_quantiles_are_exact_under_skew(spark, limit):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(400, 7.0), rng.normal(10, 40, 700).round(2), rng.integers(0, 5, 101)])
    df = spark.createDataFrame(pd.DataFrame({"v": values, "e": np.nan}))
    points = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = exact_quantiles(df, ["v", "e"], points, limit=limit)
    assert got["e"] is None
    assert np.allclose(got["v"], pd.Series(values).quantile(list(points)).tolist(), rtol=0, atol=1e-12)


def test_detectors(spark):
    data = [
        (0, " a ", "1", "x@y.com", "5551234567", "2024-01-01", None),
        (1, "A", "2,5", "bad", "12", "nope", None),
        (2, "a", "-3", "", "call", "01/02/2024", None),
        (3, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(
        data, f"{ROW_ID} long, name string, num string, email string, telefono string, fecha string, Columna_7 string"
    )
    got = found(detect.analyze_issues(df))
    assert got[("empty_rows", None)].affected == 1
    assert got[("empty_columns", None)].examples == ["Columna_7"] and got[("empty_columns", None)].total == 6
    assert got[("auto_named_column", "Columna_7")].affected == 0 if ("auto_named_column", "Columna_7") in got else True
    assert got[("missing_values", "Columna_7")].severity == "HIGH"
    assert got[("missing_values", "name")].ratio == 0.25 and got[("missing_values", "name")].severity == "MEDIUM"
    assert got[("blank_strings", "email")].affected == 1
    assert got[("extra_whitespace", "name")].affected == 1
    assert (got[("case_variants", "name")].affected, got[("case_variants", "name")].examples) == (3, ["a"])
    assert got[("numbers_as_text", "num")].examples == ["1", "2,5", "-3"]
    assert (got[("inconsistent_dates", "fecha")].affected, got[("inconsistent_dates", "fecha")].examples) == (1, ["nope"])
    assert got[("suspicious_emails", "email")].affected == 2
    assert got[("suspicious_phones", "telefono")].examples == ["12", "call"]
    order = [r.position for r in detect.analyze_issues(df).orderBy("position").collect()]
    assert order == sorted(order)


def test_duplicates(spark):
    data = [("a", 1), ("a", 1), ("A ", 1), ("b", 2), (None, None), (None, None)]
    df = spark.createDataFrame(data, "s string, n int")
    assert tuple(detect.duplicate_counts(df).first()) == (6, 2, 1)
    assert found(detect.possible_duplicates(df))[("possible_duplicates", None)].affected == 1
    assert detect.possible_duplicates(df.select("n")).count() == 0


def test_outliers_need_spread_and_samples(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(20)] + [(500.0, 9.0)], "v double, flat double")
    got = found(detect.iqr_outliers(df))
    assert set(got) == {("iqr_outliers", "v")} and got[("iqr_outliers", "v")].examples == ["500.0"]
    assert detect.iqr_outliers(df.limit(5)).count() == 0


def test_issue_rules_are_unapproved(spark):
    df = spark.createDataFrame([(" a",), ("b",)], "s string")
    plan = propose.rules_from_issues(detect.analyze_issues(df))
    assert [(r.action, r.column, r.approved, r.source) for r in plan.rules] == [("trim_text", "s", False, "analyzer")]


def test_safe_payload_holds_no_values(spark):
    df = spark.createDataFrame([(0, "secret@value"), (1, "other")], f"{ROW_ID} long, email string")
    text = profile.safe_profile(profile.profile(df), detect.analyze_issues(df), profile.table_stats(df)).first().payload
    payload = json.loads(text)
    assert "secret" not in text and "other" not in text
    assert payload["row_count"] == 2 and "trim_text" in payload["allowed_actions"]


def test_proposed_passes(spark):
    data = [(i, f"0{i % 9 + 1}/05/2026", f"$ {i}.250,50", (" Ana " if i % 2 else "ana") if i else "Beto", "08011", "5%") for i in range(10)]
    df = spark.createDataFrame(data, f"{ROW_ID} long, d string, m string, n string, zip string, p string")
    pipeline = propose.propose(df)
    one, two, three = (pipeline.passes[k].rules for k in propose.PASSES)
    assert [(r.action, r.column) for r in one] == [("trim_text", "n"), ("normalize_case", "n")]
    assert [(r.action, r.column) for r in two] == [("normalize_dates", "d"), ("normalize_numbers", "m"), ("normalize_numbers", "p")]
    assert two[2].parameters["convert_percentages"] and not two[1].parameters["convert_percentages"]
    assert [r.action for r in three][0] == "drop_empty_rows" and [r.action for r in three][-1] == "dedupe_exact"
    assert "d" not in [r.column for r in three]
    out = pipeline.apply(df)
    assert out.count() == 10 and out.first().zip == "08011"
    assert out.filter("p = 0.05").count() == 10


def test_multipass_trims_before_duplicates_and_passes_can_be_chosen(spark):
    data = [(0, " Ana", "a@x"), (1, "ana ", "a@x"), (2, "Beto", "b@x"), (3, "beto", "b@x"), (4, "Ana", "a@x")]
    df = spark.createDataFrame(data, f"{ROW_ID} long, name string, email string")
    pipeline = propose.propose(df)
    assert pipeline.apply(df).count() == 2
    counts = [(r["pass"], r.rows_before, r.rows_after) for r in pipeline.row_counts(df).collect()]
    assert counts == [("pass1", 5, 5), ("pass3", 5, 2)]
    assert pipeline.enable([]) is None
    with pytest.raises(R.RuleError):
        propose.Pipeline({"pass9": pipeline.plan()})


def test_empty_table_gets_only_global_rules(spark):
    df = spark.createDataFrame([], "a string, b int")
    rules = propose.propose(df).plan().rules
    assert [r.action for r in rules if r.column is None] == ["drop_empty_rows", "dedupe_exact"]
    assert all(r.action == "blank_to_null" for r in rules if r.column)


def test_proposal_intake(spark):
    good = {"action": "trim_text", "column": "a", "reason": "r" * 800, "confidence": 0.9, "parameters": {"x": 1}}
    docs = [
        json.dumps({"proposals": [good, {**good, "confidence": "0.9"}, {**good, "confidence": 2}, {**good, "action": "rm"}, 5, {**good, "confidence": True, "parameters": [1]}]}),
        json.dumps({"proposals": [good] * 25}),
        json.dumps({"proposals": "none"}),
        json.dumps({}),
        "not json",
    ]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc int, response string")
    out = intake_proposals(df, "response", ["doc"], most=20, reason_chars=500).orderBy("doc", "ordinal").collect()
    by_doc = lambda d: [r for r in out if r.doc == d]
    assert [r.accepted for r in by_doc(0)] == [True, False, False, False, False, True]
    assert len(by_doc(0)[0].reason) == 500 and by_doc(0)[0].note == "reason was shortened"
    assert by_doc(0)[5].confidence == 1.0 and by_doc(0)[5].parameters == "{}"
    assert sum(r.accepted for r in by_doc(1)) == 20 and len(by_doc(1)) == 25
    assert [r.note for r in by_doc(2)] == ["proposals is not a list"]
    assert [r.note for r in by_doc(3) + by_doc(4)] == ["no valid proposal"] * 2
    every = intake_proposals(df, "response", ["doc"])
    assert {k: len(p.rules) for k, p in plans_from_proposals(every, ["doc"]).items()} == {(0,): 2, (1,): 25}
    assert every.agg(F.max(F.length("reason"))).first()[0] == 800
    plan = rules_from_proposals(intake_proposals(df.filter("doc = 0"), "response"))
    assert [(r.action, r.parameters, r.approved) for r in plan.rules] == [("trim_text", {"x": 1}, False), ("trim_text", {}, False)]


def test_plan_sizes_gather_no_proposal(spark, monkeypatch):
    from checks import queries

    good = {"action": "trim_text", "column": "a", "reason": "r", "confidence": 0.9}
    response = json.dumps({"proposals": [good, {**good, "action": "rm"}, good]})
    df = spark.createDataFrame([(i, response) for i in range(25)], "event_id long, response string")
    monkeypatch.setattr(queries, "view", lambda *_: df)
    monkeypatch.setattr(queries.intake, "plans_from_proposals", None)
    sizes = {r.team: r.n_rules for r in queries.intake_plan_size(spark, "").collect()}
    assert sizes == {team: 6 if team < 5 else 4 for team in range(10)}
    every = intake_proposals(df, "response", ["event_id"])
    assert {r.event_id: r.n_rules for r in plan_sizes(every, ["event_id"]).collect()} == dict.fromkeys(range(25), 2)
    assert {k: len(p.rules) for k, p in plans_from_proposals(every, ["event_id"], (7,)).items()} == {(7,): 2}


def test_spelling_groups_and_rollup_of_many_columns(spark):
    wide = spark.range(50).select(*[F.concat(F.lit("v"), (F.col("id") % (i + 2)).cast("string")).alias(f"c{i}") for i in range(60)])
    got = {r["column"]: r.distinct for r in profile.profile(wide).collect()}
    assert got["c0"] == 2 and got["c40"] == 42 and len(got) == 60
    assert detect.analyze_issues(wide, examples=False).filter("category = 'case_variants'").count() == 0
