import zipfile

import pytest
from pyspark.sql import functions as F

from tablewright.columns import ROW_ID, SOURCE_FILE
from tablewright.folder import clean_folder
from tablewright.operators import audit, batch
from tablewright.operators.validate import CleanResult, ValidationResult, validate
from tablewright.plans import rules as R
from tablewright.plans.plan import Plan
from tablewright.runner import clean_table, stage
from tablewright.sinks.publish import PublishError, publish
from tablewright.sources import text, workbook
from tablewright.sources.text import read_text
from tablewright.sources.headers import IngestError, header_names
from tablewright.sources.inventory import inventory
from tablewright.streaming.incremental import apply_stream, clean_new_files


def people(spark):
    data = [(0, " Juan ", "1"), (1, "Juan", "2"), (2, None, "x"), (3, "Ana", None)]
    return spark.createDataFrame(data, f"{ROW_ID} long, name string, note string")


PLAN = Plan((R.trim_text("name"), R.dedupe_by_key(["name"]))).approve()


def test_valid_candidate(spark):
    df = people(spark)
    candidate = stage(PLAN.apply(df))
    result = CleanResult(PLAN.applied, 4, 3, 2, 2)
    assert validate(df, candidate, PLAN, result).valid


@pytest.mark.parametrize(
    "attack",
    [
        lambda c: c.withColumn("note", F.when(F.col("name") == "Ana", "!").otherwise(F.col("note"))),
        lambda c: c.withColumn("note", F.when(F.col("name") == "Juan", None).otherwise(F.col("note"))),
        lambda c: c.filter("name = 'Ana'"),
        lambda c: c.union(c.withColumn(ROW_ID, F.col(ROW_ID) + 50)),
        lambda c: c.drop("note"),
        lambda c: c.withColumn("extra", F.lit(1)),
        lambda c: c.select(ROW_ID, "note", "name"),
        lambda c: c.withColumnRenamed("note", "notes"),
        lambda c: c.withColumn("note", F.col("note").try_cast("double")),
    ],
)
def test_tampering_is_found(spark, attack):
    df = people(spark)
    assert not validate(df, stage(attack(PLAN.apply(df))), PLAN).valid


def test_multiset_validation_without_row_ids(spark):
    df = people(spark).drop(ROW_ID)
    plan = Plan((R.trim_text("name"), R.dedupe_exact())).approve()
    good = stage(plan.apply(df))
    assert validate(df, good, plan).valid
    assert not validate(df, stage(good.limit(2)), plan).valid
    assert not validate(df, stage(good.union(good)), plan).valid


def test_authorisation_and_metadata(spark):
    df = people(spark)
    candidate = stage(PLAN.apply(df))
    smuggled = CleanResult((*PLAN.applied, R.normalize_case("note").approve()), 4, 3, 2, 2)
    assert any("without approval" in e for e in validate(df, candidate, PLAN, smuggled).errors)
    wrong = CleanResult(PLAN.applied, 4, 4, 2, 3)
    assert sum("recorded as" in e for e in validate(df, candidate, PLAN, wrong).errors) == 2
    wider = Plan((R.trim_text("name"), R.dedupe_by_key(["name", "note"]))).approve()
    assert not validate(df, stage(wider.apply(df)), PLAN).valid
    broken = Plan((R.Rule("split_column", "name", {}, approved=True),))
    assert not validate(df, candidate, broken).valid
    strict = Plan((R.to_numeric_strict("note"),)).approve()
    assert any("'x'" in e for e in validate(df, candidate, strict).errors)


def test_transforms_compare_by_row_not_by_position(spark):
    df = people(spark)
    found = {r.action: r for r in audit.transforms(PLAN, df, PLAN.apply(df)).collect()}
    assert found["trim_text"].values_changed == 1 and found["trim_text"].summary == "changed: 1"
    assert found["dedupe_by_key"].values_changed == 1 and found["dedupe_by_key"].column == "GLOBAL"


def test_run_publishes_only_valid_results(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", " 5 "), ("b", "x"), ("b", "x")], "a string, n string")
    plan = Plan((R.trim_text("n"), R.normalize_numbers("n"), R.dedupe_exact(), R.flag_for_review("a"))).approve()
    out = clean_table(df, plan, str(tmp_path / "t"), "csv", audit_base=str(tmp_path / "audit"))
    assert out.validation.valid and out.published.rows == 2
    back = spark.read.option("header", True).csv(str(tmp_path / "t"))
    assert sorted(r.a for r in back.collect()) == ["'=1+1", "b"]
    assert out.cleaned.filter("a = '=1+1'").count() == 1
    assert any("lost" in w for w in out.result.warnings) and any("review" in w for w in out.result.warnings)
    runs = spark.read.parquet(str(tmp_path / "audit" / "audit_runs")).collect()
    assert [(r.rows_before, r.rows_after, r.valid) for r in runs] == [(3, 2, True)]
    assert spark.read.parquet(str(tmp_path / "audit" / "audit_actions")).count() == 4
    assert spark.read.parquet(str(tmp_path / "audit" / "audit_transforms")).count() == 3
    with pytest.raises(PublishError, match="overwrite"):
        publish(df, str(tmp_path / "t"), ValidationResult(True), "csv")
    with pytest.raises(PublishError, match="bad"):
        publish(df, str(tmp_path / "u"), ValidationResult(False, ("bad",)))
    assert not (tmp_path / "u").exists()
    with pytest.raises(PublishError):
        publish(df, str(tmp_path / "u"), ValidationResult(True), "xlsx")


def test_header_names():
    assert header_names(["Nombre", "", " Ciudad ", "Unnamed: 3"]) == ["Nombre", "Columna_2", "Ciudad", "Columna_4"]
    assert header_names(["%", "名前"], 3) == ["%", "名前", "Columna_3"]
    for bad in (["Col1", "Col1"], ["ID", "Nombre", " NOMBRE "], []):
        with pytest.raises(IngestError):
            header_names(bad)


def write(folder, name, data):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder / name)


@pytest.mark.parametrize(
    "data,columns,rows",
    [
        ("ID;Nombre;Ciudad\n1;José;Málaga\n2;Ana;León\n", ["ID", "Nombre", "Ciudad"], [("1", "José", "Málaga"), ("2", "Ana", "León")]),
        ("Correos\na@x\nb@x\n", ["Correos"], [("a@x",), ("b@x",)]),
        ("ID,Valor,Vacio\n1,NA,\n2,null, \n3,\"\",\"\"\n", ["ID", "Valor", "Vacio"], [("1", "NA", None), ("2", "null", " "), ("3", None, None)]),
        ("﻿A\tB\n1\t2\n", ["A", "B"], [("1", "2")]),
        ("N,C\nJosé,Málaga\n".encode("cp1252"), ["N", "C"], [("José", "Málaga")]),
        (b"A,B\n" + b"x,y\n" * 700 + b"\x93 7 \x94,z\n", ["A", "B"], [("x", "y")] * 700 + [("“ 7 ”", "z")]),
        (b"A,B\n\x81,\xe9\n", ["A", "B"], [("\x81", "é")]),
        ('A|B\n"x\n1"|"a ""q"" | b"\nshort\n', ["A", "B"], [("short", None), ("x\n1", 'a "q" | b')]),
    ],
)
def test_text_files(spark, tmp_path, data, columns, rows):
    good, bad = text.read_text(spark, write(tmp_path, "f.csv", data))
    assert good.columns == [SOURCE_FILE, ROW_ID, *columns]
    assert sorted(good.select(*columns).collect(), key=str) == sorted(rows, key=str)
    assert bad.count() == 0


def test_long_rows_are_set_aside_and_types_inferred(spark, tmp_path):
    path = write(tmp_path, "f.csv", "a,b,c,d\n1,2.5,True,08\n4,5,6,7,8\n-3,,false,yes\n")
    good, bad = text.read_text(spark, path)
    assert [r.record for r in bad.collect()] == ["4,5,6,7,8"]
    typed = text.infer_types(good)
    assert [f.dataType.simpleString() for f in typed.schema.fields][2:] == ["bigint", "double", "boolean", "string"]


def test_unreadable_files_are_reported(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "dup.csv", "a,A \n1,2\n")
    write(folder, "blank.csv", "\n\n")
    write(folder, "empty.csv", b"")
    write(folder, "old.xls", b"x")
    write(folder, "note.txt", b"x")
    found = {r.path.rsplit("/", 1)[1]: r.problem for r in inventory(spark, str(folder)).collect()}
    assert set(found) == {"dup.csv", "blank.csv", "empty.csv", "old.xls"} and found["empty.csv"] == "empty file"
    _, failures = text.describe(spark, [str(folder / "dup.csv"), str(folder / "blank.csv")])
    assert len(failures) >= 1 and "duplicate" in " ".join(r for _, r in failures)
    with pytest.raises(IngestError):
        inventory(spark, str(tmp_path / "nowhere"))


def make_workbook(path, sheets):
    """A minimal workbook; a cell is text, a number, a boolean, or ('date', serial)."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'

    def cell(ref, value):
        if value is None:
            return ""
        if isinstance(value, tuple):
            return f'<c r="{ref}" s="1"><v>{value[1]}</v></c>'
        if isinstance(value, bool):
            return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{ref}"><v>{value}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'

    with zipfile.ZipFile(path, "w") as book:
        names = list(sheets)
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(names)))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        items = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(names))
        book.writestr("xl/workbook.xml", f"<workbook {ns} {rel}><sheets>{items}</sheets></workbook>")
        book.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, name in enumerate(names):
            rows = "".join(
                f'<row r="{r}">{"".join(cell(f"{chr(65 + c)}{r}", v) for c, v in enumerate(row))}</row>'
                for r, row in enumerate(sheets[name], start=1)
            )
            book.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    return str(path)


def test_workbooks(spark, tmp_path):
    path = make_workbook(
        tmp_path / "w.xlsx",
        {"Portada": [], "Datos": [["Cliente", "Monto", None], ["Ana", 1250.5, "x"], ["Beto", None], [True, ("date", 45292)]]},
    )
    df = workbook.read_workbook(spark, path)
    assert df.columns == [SOURCE_FILE, ROW_ID, "Cliente", "Monto", "Columna_3"]
    got = [tuple(r)[2:] for r in df.orderBy(ROW_ID).collect()]
    assert got == [("Ana", "1250.5", "x"), ("Beto", None, None), ("True", "2024-01-01", None)]
    assert [r.sheet for r in workbook.list_sheets(workbook.workbook_rows(spark, [path])).orderBy("sheet_no").collect()] == ["Portada", "Datos"]
    only_header = make_workbook(tmp_path / "h.xlsx", {"S": [["A", "B"]]})
    assert workbook.read_workbook(spark, only_header).count() == 0
    for bad in (make_workbook(tmp_path / "e.xlsx", {"S": []}), write(tmp_path, "c.xlsx", b"not a zip")):
        with pytest.raises(IngestError):
            workbook.read_workbook(spark, bad)


def test_text_files_survive_the_whole_path(spark, tmp_path):
    """Files of two formats through read_text and clean_table; no row id repeats, nothing is lost."""
    a = write(tmp_path, "a.csv", 'x,y,z\n1, a ,\n1, a ,\n5" pipe,3" bolt,c,LOST\n"q,1",2,3\n')
    b = write(tmp_path, "b.csv", "x;y;z\n1; a ;\n2;b\n1;2;3;;5\n")
    good, bad = read_text(spark, [a, b])
    assert sorted(r.record for r in bad.collect()) == ["1;2;3;;5", '5" pipe,3" bolt,c,LOST']
    ids = [r[ROW_ID] for r in good.collect()]
    assert len(ids) == len(set(ids)) == 5
    outcome = clean_table(good, Plan((R.trim_text("y"), R.dedupe_exact())).approve())
    assert outcome.validation.valid, outcome.validation.errors
    got = sorted(tuple(r) for r in outcome.cleaned.select("x", "y", "z").collect())
    assert got == [("1", "a", None), ("2", "b", None), ("q,1", "2", "3")]
    with pytest.raises(IngestError):
        read_text(spark, write(tmp_path, "c.csv", "_row_id,x\n1,2\n"))


def test_published_text_keeps_every_cell(spark, tmp_path):
    cells = [" a ", "b\t", None, "", '"q"', "x,y", "l\nm", "=f"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "n int, c string")
    publish(df, str(tmp_path / "two"), ValidationResult(True), "csv")
    good, bad = read_text(spark, str(tmp_path / "two"))
    want = [c or None for c in cells[:-1]] + ["'=f"]
    assert [r.c for r in sorted(good.collect(), key=lambda r: int(r.n))] == want and bad.count() == 0
    publish(df.select("c"), str(tmp_path / "one"), ValidationResult(True), "csv")
    good, _ = read_text(spark, str(tmp_path / "one"))
    assert sorted((r.c for r in good.collect()), key=str) == sorted(want, key=str)
    with pytest.raises(PublishError):
        publish(df, str(tmp_path / "two"), ValidationResult(True), "csv")
    publish(df.filter("n > 3"), str(tmp_path / "two"), ValidationResult(True), "csv", overwrite=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "two")).count() >= 4
    assert [p.name for p in tmp_path.iterdir() if "writing" in p.name] == []


def test_folder_edge_files(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "header.csv", "a;b\n")
    write(folder, "rows.csv", "file,v\nx1,1\nx2,2\nx0,3\n")
    write(folder, "twice.csv", "k,K\n1,2\n")
    run = clean_folder(spark, str(folder), str(tmp_path / "out"))
    items = {r.source.rsplit("/", 1)[1]: (r.status, r.rows_before, r.result) for r in run.items.collect()}
    assert items == {"header.csv": ("ok", 0, "UNCHANGED"), "rows.csv": ("ok", 3, "UNCHANGED"), "twice.csv": ("error", None, None)}
    rows = spark.read.option("header", True).csv(run.output + "/kind=*/_file=rows-*")
    assert [r.file for r in rows.collect()] == ["x1", "x2", "x0"]
    assert spark.read.option("header", True).csv(run.output + "/kind=*/_file=header-*").columns == ["a", "b"]


def test_folder_batch(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "clientes.csv", "Nombre,Email\n Ana ,a@x\nana,a@x\nBeto,b@x\nBETO,b@x\n")
    write(folder / "sub", "ventas.csv", "Fecha,Monto\n12/05/2026,\"$1.250,50\"\n13/05/2026,\"(150,00)\"\n01/06/2026,\"2.000,00\"\n,\n")
    write(folder, "limpio ñ+1.csv", "K;V\nUno;Dos\nTres;Cuatro\n")
    write(folder, "roto.xlsx", b"nope")
    write(folder, "vacio.csv", b"")
    write(folder, "nota.txt", b"x")
    run = clean_folder(spark, str(folder), str(tmp_path / "out"))
    items = {r.source.rsplit("/", 1)[1]: r for r in run.items.collect()}
    assert {n: r.status for n, r in items.items()} == {
        "clientes.csv": "ok", "ventas.csv": "ok", "limpio ñ+1.csv": "ok", "roto.xlsx": "error", "vacio.csv": "error"
    }
    assert (items["clientes.csv"].rows_before, items["clientes.csv"].rows_after) == (4, 2)
    assert (items["ventas.csv"].rows_after, items["ventas.csv"].result) == (3, "CLEANED")
    assert (items["limpio ñ+1.csv"].result, items["limpio ñ+1.csv"].changes) == ("UNCHANGED", 0)
    total = run.summary.first()
    assert (total.files_found, total.processed_ok, total.errors, total.cleaned, total.unchanged) == (5, 3, 2, 2, 1)
    assert batch.self_check(run.items, run.summary).first().consistent
    assert run.rejects.count() == 2
    sales = spark.read.option("header", True).csv(run.output + "/kind=*/_file=ventas-*")
    assert sorted(tuple(r) for r in sales.select("Fecha", "Monto").collect()) == [
        ("2026-05-12", "1250.5"), ("2026-05-13", "-150.0"), ("2026-06-01", "2000.0")
    ]
    again = clean_folder(spark, str(folder), str(tmp_path / "out"))
    assert again.summary.first().files_found == 5 and again.output != run.output


def test_one_source_with_most_rows(spark):
    """Decisions and duplicates belong to a source, also when one source dominates."""
    rows = [("big", i, f" v{i % 5} ", "1,5") for i in range(300)] + [("small", 1000 + i, f"v{i}", "word") for i in range(9)]
    df = spark.createDataFrame(rows, f"{SOURCE_FILE} string, {ROW_ID} long, a string, b string")
    out = batch.clean_sources(df, batch.source_decisions(df))
    counts = {r[SOURCE_FILE]: r["count"] for r in out.groupBy(SOURCE_FILE).count().collect()}
    assert counts == {"big": 5, "small": 9}
    assert {r.b for r in out.collect()} == {"1.5", "word"}


def test_streams(spark, tmp_path):
    folder, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    plan = Plan((R.trim_text("a"), R.split_column("b", "-", ["x", "y"]))).approve()

    def deliver(name, body):
        write(tmp_path / "in", name, body)
        clean_new_files(spark, folder, "a string, b string", plan, target, progress).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(target).select("a", "x", "y").collect())

    assert deliver("1.csv", "a,b\n q ,1-2\n") == [("q", "1", "2")]
    assert deliver("2.csv", "a,b\n r ,3\n") == [("q", "1", "2"), ("r", "3", None)]
    stream = spark.readStream.schema("a string, b string, ts timestamp").option("header", True).csv(folder)
    with pytest.raises(R.RuleError):
        apply_stream(stream, Plan((R.drop_empty_columns(),)).approve())
    with pytest.raises(R.RuleError):
        apply_stream(stream, Plan((R.dedupe_exact(),)).approve())
    kept = apply_stream(stream, Plan((R.dedupe_by_key(["a"]),)).approve(), "ts")
    assert kept.isStreaming and kept.columns == ["a", "b", "ts"]
