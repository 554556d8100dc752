from pyspark.sql import functions as F

from tablewright.columns import ROW_ID
from tablewright.operators import validate

NAN = float("nan")
SCHEMA = f"{ROW_ID} long, a string, b string, x double, l array<string>"


def differences(df):
    return {r.column: r.differing for r in df.collect() if r.differing}


def test_equal_tables_need_no_cell_join(spark, monkeypatch):
    rows = [(i, f"a{i}", None if i % 3 else "b", [0.0, -0.0, NAN, None][i % 4], ["x", None]) for i in range(500)]
    one = spark.createDataFrame(rows, SCHEMA)
    other = spark.createDataFrame([(*r[:3], {0.0: -0.0}.get(r[3], r[3]), r[4]) for r in rows[::-1]], SCHEMA).repartition(5)
    monkeypatch.setattr(validate, "_joined_differences", lambda *a: 1 / 0)
    assert differences(validate.cell_differences(one, other)) == {}
    assert differences(validate.cell_differences(one.limit(0), other.limit(0))) == {}
    assert validate.differing_buckets(one, other, [ROW_ID]).count() == 0


def test_only_buckets_that_differ_are_joined(spark, monkeypatch):
    one = spark.range(2000).selectExpr(f"id {ROW_ID}", "string(id) a", "if(id % 7 = 0, null, 'b') b", "id / 2 x", "array('x') l")
    changes = {
        "moved null": one.withColumn("a", F.expr(f"if({ROW_ID} = 7, null, a)")).withColumn("b", F.expr(f"if({ROW_ID} = 7, '7', b)")),
        "lost": one.filter(f"{ROW_ID} <> 8"),
        "twice": one.unionByName(one.filter(f"{ROW_ID} in (9, 10)")),
        "other": one.withColumn(ROW_ID, F.expr(f"if({ROW_ID} = 11, -11, {ROW_ID})")),
    }
    joined = []
    whole = validate._joined_differences

    def watched(expected, candidate, key, names):
        joined.append(expected.count() + candidate.count())
        return whole(expected, candidate, key, names)

    monkeypatch.setattr(validate, "_joined_differences", watched)
    names = ["a", "b", "x", "l"]
    for label, other in changes.items():
        got = differences(validate.cell_differences(one, other))
        assert got == differences(whole(one, other, [ROW_ID], names)), label
        # A row that is there twice has no other cells, but it does have another digest.
        assert validate.differing_buckets(one, other, [ROW_ID]).count() in (1, 2), label
    assert len(joined) == 4 and max(joined) < 40


def test_many_differences_and_types_without_hash(spark):
    one = spark.range(5000).selectExpr(f"id {ROW_ID}", "string(id) a")
    assert differences(validate.cell_differences(one, one.withColumn("a", F.lit("?")))) == {"a": 5000}
    with_map = one.filter(f"{ROW_ID} < 3").withColumn("m", F.expr("struct(a as a)"))
    assert differences(validate.cell_differences(with_map, with_map)) == {}
    assert not validate._hashable(spark.range(1).selectExpr("map(1, 2) m").schema["m"].dataType)
