"""Workbooks: many files in parallel, each parsed by one task into rows of text cells."""

from __future__ import annotations

import io
import re
import zipfile
from collections import defaultdict
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.columns import ROW_ID, SOURCE_FILE, column
from tablewright.functions import constants as K
from tablewright.sources.headers import IngestError, header_names
from tablewright.sources.inventory import canonical_path

CELL_SCHEMA = "path string, sheet_no int, sheet string, row_no long, cells array<string>, problem string"
# Built-in number formats that show a date or a time.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_EPOCH = datetime(1899, 12, 30)


def _tag(name: str) -> str:
    return "{*}" + name


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match("[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId"))
        for f in root.iterfind(f"{_tag('numFmts')}/{_tag('numFmt')}")
        if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())
    }
    formats = root.iterfind(f"{_tag('cellXfs')}/{_tag('xf')}")
    return {i for i, xf in enumerate(formats) if int(xf.get("numFmtId", 0)) in _DATE_FORMATS | custom}


def _cell_text(cell, shared: list[str], date_styles: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if t.tag.endswith("}t"))
    value = cell.find(_tag("v"))
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "True" if value.text == "1" else "False"
    if kind == "n" and int(cell.get("s", 0)) in date_styles:
        moment = _EPOCH + timedelta(days=float(value.text))
        return moment.strftime("%Y-%m-%d" if moment.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")
    return value.text


def _sheet_rows(path: str, content: bytes) -> Iterator[tuple]:
    book = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
        shared = [
            "".join(t.text or "" for t in item.iter() if t.tag.endswith("}t"))
            for item in root.iterfind(_tag("si"))
        ]
    styles = _date_styles(book)
    links = {
        rel.get("Id"): rel.get("Target")
        for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iterfind(f"{_tag('sheets')}/{_tag('sheet')}")
    for number, sheet in enumerate(sheets):
        link = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
        target = links[link].lstrip("/")
        target = target if target.startswith("xl/") else f"xl/{target}"
        # A marker names the sheet even if it is empty. Rows are streamed and dropped.
        yield path, number, sheet.get("name"), 0, [], None
        row_no = 0
        for _, row in ElementTree.iterparse(book.open(target)):
            if not row.tag.endswith("}row"):
                continue
            row_no = int(row.get("r", row_no + 1))
            cells: list[str | None] = []
            for cell in row.iterfind(_tag("c")):
                place = _column_index(cell.get("r")) if cell.get("r") else len(cells)
                cells.extend([None] * (place - len(cells)))
                cells.append(_cell_text(cell, shared, styles))
            yield path, number, sheet.get("name"), row_no, cells, None
            row.clear()


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "sheet_no", "sheet", "row_no", "cells", "problem"]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows: list[tuple] = []
            try:
                for row in _sheet_rows(path, content):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            except Exception as error:  # noqa: BLE001 - one broken file must not stop the others
                rows.append((path, None, None, None, None, f"unreadable workbook: {type(error).__name__}"))
            yield pd.DataFrame(rows, columns=columns)


def workbook_rows(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, sheet_no, sheet, row_no, cells, problem): every row of every sheet of many workbooks."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(canonical_path(F.col("path")).alias("path"), "content").mapInPandas(_parse, CELL_SCHEMA)


def list_sheets(rows: DataFrame) -> DataFrame:
    return rows.filter("sheet_no is not null").select("path", "sheet_no", "sheet").distinct()


def describe(
    rows: DataFrame, sheet: str | None = None
) -> tuple[dict[tuple[str, ...], list[tuple[str, int]]], list[tuple[str, str]]]:
    """Workbooks grouped by column names as (path, sheet number), and unusable ones with a reason.

    Without a sheet name the first sheet counts whose first row holds a non-blank cell.
    """
    filled = F.exists("cells", lambda c: F.btrim(c, F.lit(K.WHITESPACE)) != "")
    usable = filled if sheet is None else (F.col("sheet") == sheet)
    first = rows.filter((F.col("row_no") == 1) & usable).groupBy("path").agg(
        F.min_by(F.struct("sheet_no", "cells"), "sheet_no").alias("head")
    )
    widths = rows.groupBy("path", "sheet_no").agg(F.max(F.size("cells")).alias("width"))
    problems = rows.groupBy("path").agg(F.max("problem").alias("problem"))
    heads = problems.join(first, "path", "left").select("path", "problem", "head.sheet_no", "head.cells")
    found = heads.join(widths, ["path", "sheet_no"], "left")
    groups: dict[tuple[str, ...], list[tuple[str, int]]] = defaultdict(list)
    failures: list[tuple[str, str]] = []
    # One record per workbook.
    for row in found.orderBy("path").toLocalIterator():
        try:
            if row.problem:
                raise IngestError(row.problem)
            if row.sheet_no is None:
                raise IngestError("no sheet with a header" if sheet is None else f"no sheet '{sheet}'")
            groups[tuple(header_names(row.cells, row.width))].append((row.path, row.sheet_no))
        except IngestError as error:
            failures.append((row.path, str(error)))
    return dict(groups), failures


def table_of(rows: DataFrame, names: Sequence[str], sheets: Sequence[tuple[str, int]]) -> DataFrame:
    """The data rows of sheets with equal column names, as a table of text columns."""
    chosen = rows.sparkSession.createDataFrame(list(sheets), "path string, sheet_no int")
    # One small record per workbook; above the session's limit Spark joins by shuffle instead.
    data = rows.filter(F.col("row_no") > 1).join(chosen, ["path", "sheet_no"], "left_semi")
    return data.select(
        F.col("path").alias(SOURCE_FILE),
        F.col("row_no").alias(ROW_ID),
        *[F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)],
    )


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet of one workbook as a table of text columns."""
    from tablewright.runner import stage

    rows = stage(workbook_rows(spark, [path]), "workbook")
    groups, failures = describe(rows, sheet)
    if failures:
        raise IngestError(failures[0][1])
    ((names, sheets),) = groups.items()
    return table_of(rows, names, sheets)
