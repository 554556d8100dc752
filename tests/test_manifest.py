"""A cleaned folder follows added, replaced, touched and deleted files; proposals and their scans."""

import os

import pytest

from tablewright.plans import rules as R
from tablewright.plans.plan import Plan
from tablewright.plans.propose import column_shapes
from tablewright.plans.rules import RuleError
from tablewright.streaming.manifest import content_digests, manifest, read_synced, sync_folder

SCHEMA = "a string, b string"


def put(folder, name, text, age=0):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as file:
        file.write(text)
    stamp = 1_700_000_000 + age
    os.utime(path, (stamp, stamp))


def kinds(synced):
    return sorted((r.path.rsplit("/", 1)[1], r.change) for r in synced.changes.collect())


def shown(spark, target, version=None):
    rows = read_synced(spark, target, SCHEMA, version).collect()
    return sorted((r._source_file.rsplit("/", 1)[1], r.a, r.b) for r in rows)


def test_added_replaced_touched_and_deleted_files(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    os.mkdir(folder)
    plan = Plan((R.trim_text("a"),)).approve()
    put(folder, "one.csv", "a,b\n x ,1\n")
    put(folder, "two.csv", "a,b\n y ,2\nz,3\n")
    put(folder, "three.csv", "b,a\n4, w\n")
    put(folder, "odd.csv", "c,d\n1,2\n")
    put(folder, "none.csv", "")
    first = sync_folder(spark, folder, SCHEMA, plan, target)
    assert {k for _, k in kinds(first)} == {"added"} and len(kinds(first)) == 5
    before = [("one.csv", "x", "1"), ("three.csv", "w", "4"), ("two.csv", "y", "2"), ("two.csv", "z", "3")]
    assert shown(spark, target) == before
    assert spark.read.parquet(f"{target}/rejects").count() == 1

    put(folder, "one.csv", "a,b\n x ,1\n", age=50)  # the same bytes at another time
    put(folder, "two.csv", "a,b\nz,3\n y ,2\n", age=50)  # the same lines in another order
    os.remove(os.path.join(folder, "three.csv"))
    put(folder, "four.csv", "a,b\n v ,5\n")
    second = sync_folder(spark, folder, SCHEMA, plan, target)
    assert kinds(second) == [
        ("four.csv", "added"), ("one.csv", "touched"), ("three.csv", "deleted"), ("two.csv", "replaced"),
    ]
    after = [("four.csv", "v", "5"), ("one.csv", "x", "1"), ("two.csv", "y", "2"), ("two.csv", "z", "3")]
    assert shown(spark, target) == after
    held = {r.path.rsplit("/", 1)[1]: r.held_by for r in manifest(spark, target).collect()}
    assert held == {"one.csv": 0, "two.csv": 1, "four.csv": 1, "odd.csv": 0, "none.csv": None}
    # Only what changed was cleaned again, and the former state can still be read.
    assert spark.read.parquet(f"{target}/rows/version=1").count() == 3
    assert shown(spark, target, 0) == before
    third = sync_folder(spark, folder, SCHEMA, plan, target)
    assert kinds(third) == [] and shown(spark, target) == after


def test_a_run_without_its_manifest_is_repeated(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    os.mkdir(folder)
    put(folder, "one.csv", "a,b\nx,1\n")
    sync_folder(spark, folder, SCHEMA, Plan(), target)
    put(folder, "one.csv", "a,b\ny,1\n", age=9)
    sync_folder(spark, folder, SCHEMA, Plan(), target)
    os.remove(f"{target}/manifest/version=1/_SUCCESS")  # as if it had died before the end
    assert shown(spark, target) == [("one.csv", "x", "1")]
    again = sync_folder(spark, folder, SCHEMA, Plan(), target)
    assert again.version == 1 and shown(spark, target) == [("one.csv", "y", "1")]


def test_rules_over_several_rows_and_files_that_never_fit(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    os.mkdir(folder)
    put(folder, "odd.csv", "c,d\n1,2\n")
    with pytest.raises(RuleError):
        sync_folder(spark, folder, SCHEMA, Plan((R.dedupe_exact(),)).approve(), target)
    sync_folder(spark, folder, SCHEMA, Plan(), target)
    assert shown(spark, target) == []


def test_digest_sees_the_order_of_equal_lines(spark, tmp_path):
    put(str(tmp_path), "p.csv", "u\nv\nw\n")
    put(str(tmp_path), "q.csv", "w\nv\nu\n")
    put(str(tmp_path), "r.csv", "u\nv\nw\n")
    found = {r.path.rsplit("/", 1)[1]: r.digest for r in content_digests(spark, [f"{tmp_path}/{n}.csv" for n in "pqr"]).collect()}
    assert found["p.csv"] == found["r.csv"] != found["q.csv"]


def test_proposals_of_fifty_columns_read_the_table_once(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(20).selectExpr(*[f"concat(' v', id % 3) as c{i}" for i in range(50)]).write.parquet(path)
    shapes = column_shapes(spark.read.parquet(path))
    plan = shapes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    rows = shapes.collect()
    assert len(rows) == 50 and all(r.outer_space and r.filled == 20 and not r.mixed_case for r in rows)


def test_proposals_of_a_table_without_rows_and_of_cases(spark):
    empty = column_shapes(spark.createDataFrame([], "a string, b string")).collect()
    assert sorted(r.pos for r in empty) == ["0", "1"] and not any(r.filled or r.mixed_case for r in empty)
    table = spark.createDataFrame([("ab", "x"), ("AB ", "X"), ("c", "x"), (None, " ")], "a string, b string")
    shapes = {r.pos: r for r in column_shapes(table).collect()}
    assert shapes["0"].mixed_case and shapes["0"].filled == 3 and shapes["0"].outer_space
    assert not shapes["1"].mixed_case and shapes["1"].filled == 3  # one text only
