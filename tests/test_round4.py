"""Examples of issues are sought in few rows; batches leave out what they do not need."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.columns import ROW_ID, SOURCE_FILE
from tablewright.operators import batch, detect
from tablewright.sources import quoted


@pytest.fixture()
def sorted_rows(monkeypatch):
    """Numbers of rows that were ranked for examples."""
    seen = []
    rank = detect.first_per_group

    def counted(rows, *rest):
        seen.append(rows.count())
        return rank(rows, *rest)

    monkeypatch.setattr(detect, "first_per_group", counted)
    return seen


def test_examples_rank_few_rows(spark, sorted_rows):
    df = spark.range(20_000, numPartitions=4).select((F.lit(50_000) - F.col("id")).alias("key"), F.concat(F.lit("no mail "), "id").alias("email"))
    row = detect.suspicious_emails(df, order_by="key").first()
    assert (row.affected, row.total, row.examples) == (20_000, 20_000, [f"no mail {i}" for i in (19_999, 19_998, 19_997)])
    assert sorted_rows[0] < 200


@pytest.mark.parametrize(
    "rows, examples",
    [
        ([(None, "c"), (None, "b"), (1, "a"), (2, "x@y.org"), (3, "d")], ["b", "c", "a"]),
        ([(7, "c"), (7, "b"), (7, "a"), (7, "d")], ["a", "b", "c"]),
        ([(i, f"u{i}@y.org") for i in range(50)] + [(99, "a")], ["a"]),
        ([(i, f"u{i % 3}") for i in range(40)], ["u0", "u1", "u2"]),
        ([(i, f"u{i}@y.org") for i in range(5)], None),
        ([], None),
    ],
)
def test_examples_at_the_edges(spark, rows, examples):
    df = spark.createDataFrame(rows, "key long, email string")
    row = detect.suspicious_emails(df, order_by="key").first()
    assert (row and row.examples) == examples


def test_rules_that_no_source_needs_are_left_out(spark):
    rows = [("a", i, t, "x y") for i, t in enumerate(["one", "two", "three"])]
    df = spark.createDataFrame(rows, f"{SOURCE_FILE} string, {ROW_ID} long, t string, u string")
    plan = batch.clean_sources(df, batch.source_decisions(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "_number0" not in plan and "_date0" not in plan


def test_each_source_keeps_its_own_kind(spark):
    cells = {
        "n": ["$1.50", "$2.25", "(3.75)"], "d": ["05/01/2024", "06/01/2024", "2024-01-07"], "t": ["some", " words ", "here"],
    }
    rows = [(s, i, c) for s, column in cells.items() for i, c in enumerate(column)]
    df = spark.createDataFrame(rows, f"{SOURCE_FILE} string, {ROW_ID} long, x string")
    out = batch.clean_sources(df, batch.source_decisions(df)).orderBy(ROW_ID).collect()
    got = {s: [r.x for r in out if r[SOURCE_FILE] == s] for s in cells}
    assert got == {"n": ["1.5", "2.25", "-3.75"], "d": ["2024-01-05", "2024-01-06", "2024-01-07"], "t": ["some", "words", "here"]}


def test_records_of_one_line_are_taken_whole(monkeypatch):
    lines = [b"\r", b"a,b", b"1,x", b'2,"y', b'z"', b"", b"3,w"] + [b"4,v"] * 500 + [b'5,"open']
    names = ["line", "number", "state", "chain", "first"]
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
    rows = [pa.array(v, k) for v, k in zip(zip(*((line, 7, quoted.OUTSIDE, None, True) for line in lines)), kinds)]
    one_by_one = []
    make = quoted._record_batch
    monkeypatch.setattr(quoted, "_record_batch", lambda rows, schema: one_by_one.extend(rows) or make(rows, schema))
    batch_of = pa.RecordBatch.from_arrays(rows, names=names)
    found = sorted(
        (tuple(r.values()) for b in quoted._pieces(iter([batch_of.slice(0, 4), batch_of.slice(4)]), ",") for r in b.to_pylist()),
        key=lambda r: (r[1] is None, r[1] or 0),
    )
    want = [b"a,b", b"1,x", b'2,"y\nz"', b"", b"3,w"] + [b"4,v"] * 500
    assert found == [(7, i, None, i == 0, record) for i, record in enumerate(want)] + [(7, 505, 7, False, b'5,"open')]
    assert len(one_by_one) <= 2
