"""What the findings of round 3 asked for."""

import inspect
import shutil

from checks.queries import QUERIES
from pyspark.sql import functions as F

from tablewright.columns import ROW_ID, SOURCE_FILE
from tablewright.operators import batch, rows
from tablewright.sources import text


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_of_part_files_is_one_entry(spark, tmp_path):
    root = tmp_path / "data.parquet"
    spark.range(100).repartition(3).write.parquet(str(root / "lineitem.parquet"))
    spark.range(9).selectExpr("id", "id % 3 as part").write.partitionBy("part").parquet(str(root / "orders.parquet"))
    spark.range(1).coalesce(1).write.parquet(str(tmp_path / "one"))
    shutil.copy(next((tmp_path / "one").glob("*.parquet")), root / "nation.parquet")
    found = sorted(tuple(r) for r in QUERIES["file_inventory"](spark, str(root)).collect())
    assert found == [(name, ".parquet", "unsupported file type") for name in ("lineitem", "nation", "orders")]


def test_types_of_whole_columns(spark):
    cases = {
        "bigint": ["9223372036854775807", "-9223372036854775808", "+0000000000000000000012", None], "double": ["9007199254740992", "-inf", "1.5e3"],
        "boolean": ["TRUE", " false "], "string": ["9223372036854775808", "1"],
    }
    cases_more = {"rounded": ["9007199254740993", "1.5"], "empty": [None, None], "words": ["true", "1"], "small": ["-9007199254740992", ".5"]}
    want = {**{n: n for n in cases}, "rounded": "string", "empty": "string", "words": "string", "small": "double"}
    every = {**cases, **cases_more}
    longest = max(map(len, every.values()))
    table = [tuple(v[i] if i < len(v) else None for v in every.values()) for i in range(longest)]
    typed = text.infer_types(spark.createDataFrame(table, ", ".join(f"`{n}` string" for n in every)))
    assert dict(typed.dtypes) == want


def test_format_is_found_without_a_sort_of_the_lines(spark, tmp_path):
    """The lines go through one pass per file block; no aggregate over them needs a sort."""
    (tmp_path / "a+b.csv").write_bytes("  \nx;y\n1;\"a,b\"\n2;é\n".encode())
    (tmp_path / "c.csv").write_bytes("x|y\n1|caf\xe9\n2|\x81\n3|\"a\nb\"\n".encode("latin-1"))
    (tmp_path / "d.csv").write_bytes("x,y\n1,\x80\n".encode("latin-1"))
    (tmp_path / "blank.csv").write_bytes(b"   \n\n")
    found = {r.path.rsplit("/", 1)[1]: r for r in text.formats(spark, [str(tmp_path)]).collect()}
    assert {n: (r.encoding, r.multiline, r.separator, r.header and bytes(r.header)) for n, r in found.items()} == {
        "a+b.csv": ("UTF-8", False, ";", b"x;y"), "c.csv": ("ISO-8859-1", True, "|", b"x|y"), "d.csv": ("CP1252", False, ",", b"x,y"),
        "blank.csv": ("UTF-8", False, None, None),
    }


def test_decisions_are_written_once_and_broadcast(spark):
    df = spark.range(2000).select(
        F.concat(F.lit("f"), F.col("id") % 2).alias(SOURCE_FILE), F.col("id").alias(ROW_ID), F.concat(F.lit(" a"), F.col("id") % 5).alias("x")
    )
    chosen = batch.source_decisions(df)
    assert chosen.inputFiles() and "source_decisions" not in inspect.getsource(batch.clean_sources)
    joined = plan_of(batch.with_decisions(df, chosen, SOURCE_FILE))
    assert "BroadcastHashJoin" in joined and "hashpartitioning" not in joined


def test_first_of_equal_rows_needs_no_sort(spark):
    df = spark.range(100).select(F.col("id").alias(ROW_ID), (F.col("id") % 7).cast("string").alias("x"))
    kept = rows.dedupe_exact(df)
    assert "SortAggregate" not in plan_of(kept)
    assert sorted(r[ROW_ID] for r in kept.collect()) == list(range(7))
